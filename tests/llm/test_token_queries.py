"""Token queries against the tokenizers library, row by row."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_text_operators import texts


@pytest.fixture(scope="module")
def own():
    from tokenizers import Tokenizer

    from ctxspark.llm.bpe import vocabulary_path

    return Tokenizer.from_file(vocabulary_path())


def lines(text):
    """Lines with their line feeds; only these end a line."""
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + [parts[-1]]


def test_sections_of_each_line(spark, edge, own):
    from ctxspark.llm.attribution import section_tokens

    rows = [(20, "a\n\n\n\n\nb"), (21, "\n\n\n"), (22, "one two\n\n three\n"), (23, "日本\n語😀\n\n x")]
    extra = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (extra, edge.where("length(text) < 9000")):
        want = Counter()
        for i, t in texts(df):
            spans, at, n = own.encode(t or "", add_special_tokens=False).offsets, 0, 0
            for line in lines(t or ""):
                a, b = at, at + len(line)
                at = b
                if a < b:
                    given = sum(a <= (p + q - 1) // 2 < b for p, q in spans)
                    want[i, n, a, b, float(given), sum(p < b and q > a and (p < a or q > b) for p, q in spans)] += 1
                    n += 1
        assert Counter((r.id, r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in section_tokens(df).collect()) == want


def test_op1_query(spark, own):
    from ctxspark.llm.queries import QUERIES

    docs = dict(texts(spark.read.parquet(f"{SF}/documents.parquet")))
    total = defaultdict(int)
    for r in QUERIES["op1_token_counts"](spark, SF).collect():
        total[r.doc_id] += r.n_tokens
        assert docs[r.doc_id][r.start : r.end] == (docs[r.doc_id][r.start : r.end].split("\n")[0] + "\n")[: r.end - r.start]
    assert total == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in docs.items() if t}


def test_op4_query(spark, own):
    from ctxspark.llm.queries import QUERIES

    want = Counter()
    for i, t in texts(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    rows, bins = QUERIES["op4_best_fit_packing"](spark, SF).collect(), defaultdict(list)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for o2, n in b if o2 < o) for o, _ in sorted(b)] and sum(n for _, n in b) <= 2048
