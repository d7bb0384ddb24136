"""Line dedup where rows share an id."""

import random
from collections import Counter

from tests.llm.test_text_operators import brute_lines


def deduped(spark, rows, min_sites=2):
    from ctxspark.llm.linededup import remove_boilerplate

    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    return Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in remove_boilerplate(df, min_sites=min_sites).collect())


def test_unique_lines_of_a_repeated_id_stay(spark):
    rows = [(7, "a\nshared", "s1"), (7, "shared\nb", "s2"), (8, "shared", "s3")]
    got = deduped(spark, rows)
    assert got == brute_lines(rows, 2) == Counter([(7, 2, 1, "a"), (7, 2, 0, "shared\nb"), (8, 1, 1, "")])


def test_many_unlike_texts_of_few_ids(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 3]), "\n".join(r.choice(["x", " x", "y", "z\t", "", f"own {k}"]) for _ in range(r.randrange(7))), r.choice(["s1", "s2", "s3", None])) for k in range(200)]
    rows += rows[:40] + [(2, None, "s1")]
    for sites in (2, 4):
        assert deduped(spark, rows, sites) == brute_lines(rows, sites)
