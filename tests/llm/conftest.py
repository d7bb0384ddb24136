import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, score int, start string, line string, h string, site string, name string, n_lines string, item string, cell string"


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Ties, repeats, copies near and exact, nulls in every column, empty and very long texts."""
    r = random.Random(7)
    body = sentence(r, 60)
    passage = sentence(r, 30)
    long = " ".join(sentence(r, 9) + "\n" for _ in range(1500))
    texts = [
        (1, body, "en", "a"), (2, body, "en", "b"), (3, body.replace("alpha", "omega", 1), "en", "a"), (4, "", "en", "a"), (5, None, None, None),
        (6, "  \n\t ", "de", "c"), (7, long, "en", "d"), (7, long, "en", "d"), (8, f"start {passage} end", "fr", None), (9, f"{sentence(r, 8)} {passage}", None, "e"),
        (10, "word", "en", "f"), (11, "The " * 300, "en", "g"), (12, "Héllo wörld ça va\nfoo  bar \n\nLicensed under the MIT License", "fr", "h"), (None, body, "en", "z"), (13, "日本語 テキスト 😀\r\nx", "ja", "i"), (14, "!!! ??? ...", "en", "j"),
    ]
    # ids that come again with another text
    texts += [(7, f"The other text of this id\nfoo  bar \n{passage}", "en", "k"), (9, body, "en", "a"), (9, None, None, "q"), (7, f"foo  bar \nThe other\n{passage[:90]}", "en", "m")]
    return [(i, t, lang, s, None if t is None else len(t), "x", "y", 1, "s", "l", "h", "w", "n", "q", "i", "c") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
