"""Classifiers by held-out accuracy, vector search by brute force, and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF


def sample(n=400, seed=3):
    """Texts of two kinds: toxic ones hold a few words with a common stem."""
    r = np.random.default_rng(seed)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "tempor"]
    out = []
    for k in range(n):
        words = [clean[i] + clean[j][:2] for i, j in r.integers(0, 10, (r.integers(10, 120), 2))]
        bad = k % 3 == 0
        for _ in range(3 * bad):
            words[r.integers(0, len(words))] = "grumbl" + "".join(r.choice(list("aeiou"), 2)) + "sk"
        out.append((" ".join(words).encode(), int(bad)))
    return out


def test_toxicity_generalises_to_unseen_forms():
    from ctxspark.llm.toxicity import fit

    rows = sample()
    model = fit([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    score = model.score([t for t, _ in rows[300:]])
    y = np.array([y for _, y in rows[300:]])
    assert ((score >= 0.7) == y).mean() > 0.95
    assert model.score([b"lorem gRUMbluusk ipsum sit amet elit sed dolor"])[0] > 0.7
    empty = model.score([b"", b"...", b"lorem " * 20000])
    assert (empty < 0.5).all()


def test_toxicity_operator(spark, edge, nothing):
    from ctxspark.llm.toxicity import fit, keep_clean, score, training_sample

    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, None), (None, 1), (8, 0), (99, 1)], "id bigint, label int")
    texts, y = training_sample(edge.select("doc_id", "text").withColumnRenamed("doc_id", "id"), labels)
    assert sorted(y) == [0, 0, 1, 1]
    model = fit(texts, y)
    rows = score(edge, model).collect()
    assert Counter(r.id for r in rows) == Counter(r.doc_id for r in edge.collect()) and all(0 <= r.score <= 1 for r in rows)
    assert score(nothing, model).count() == 0 and keep_clean(edge, model, 2.0).columns == edge.columns and keep_clean(edge, model, 2.0).count() == edge.count()
    for y in ([], [0, 0, 0, 0], [1, 1, 1, 1]):
        assert ((fit(texts if y else [], y).score([b"x y"]) > 0.5) == (y == [1, 1, 1, 1])).all()


def test_language_held_out_accuracy(spark, real):
    from ctxspark.llm.language import fit, identify, training_sample

    rows = {r.doc_id: r.lang for r in real.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    model = fit(*training_sample(real.where(~real.doc_id.isin(list(held))).select("text", "lang")))
    got = {r.id: r.lang_pred for r in identify(real, model).collect()}
    assert np.mean([got[i] == rows[i] for i in held]) >= 0.93


def viterbi(scores, switch):
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        step = best[:, None] - switch * (1 - np.eye(k))
        back.append(step.argmax(0))
        best = step.max(0) + scores[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best.max()


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_optimal(seed):
    from ctxspark.llm.language import LanguageModel

    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    scores = rng.normal(0, 1, (n, 4)) + 2.5 * np.eye(4)[np.repeat(rng.integers(0, 4, 6), 10)[:n]]
    model = LanguageModel(list("abcd"), [], np.ones((4, 16), bool), switch=float(rng.choice([0.5, 3, 6])))
    path = model.label(scores)
    value = scores[np.arange(len(path)), path].sum() - model.switch * (np.diff(path) != 0).sum()
    assert np.isclose(value, viterbi(scores, model.switch)[1])


def test_language_spans_and_scripts(spark, edge, nothing):
    from ctxspark.llm.language import UNKNOWN, fit, identify, language_spans

    model = fit(["the quick brown fox jumps over that lazy dog".encode(), "der schnelle braune fuchs springt über den faulen hund".encode(), "быстрая лиса прыгает через собаку".encode()] * 3, ["en", "de", "ru"] * 3)
    mixed = "the quick fox jumps over that dog the brown fox jumps der schnelle fuchs springt über den hund der braune fuchs springt"
    spans = model.spans(mixed.encode())
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - 11) <= 1 and sum(n for _, n, _ in spans) == len(mixed.split())
    assert model.predict(["лиса".encode()])[0] == ["ru"]
    got = {}
    for r in identify(edge, model).collect():
        got[r.id] = (r.lang_pred, r.score)
    assert got[4] == got[5] == got[6] == got[14] == (UNKNOWN, 0.0) and got[13][0] != UNKNOWN and got[1][0] in ("en", "de")
    assert identify(nothing, model).count() == 0 and language_spans(nothing, model).count() == 0 and language_spans(edge, model).where("id = 7").agg({"n_words": "sum"}).first()[0] > 10_000
    none = fit([], [])
    assert none.predict([b"abc"])[0] == [UNKNOWN]


def brute_top(rows, k=5):
    out = []
    for q, v in rows:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("n", "kind"), [(3, "random"), (700, "random"), (900, "copies"), (400, "clusters"), (300, "small")])
def test_exact_top_k(spark, monkeypatch, n, kind):
    from ctxspark.llm import mtree

    monkeypatch.setattr(mtree, "SHARD", 64)
    rng = np.random.default_rng(n)
    v = rng.integers(-200, 200, (n, 8))
    if kind == "copies":
        v[rng.random(n) < 0.6] = v[0]
    if kind == "clusters":
        v = v[rng.integers(0, 6, n)] + rng.integers(-3, 4, (n, 8))
    if kind == "small":
        v = rng.integers(-1, 2, (n, 8))
    rows = [(i, v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame([(i, x, "e") for i, x in rows], "id bigint, vector array<bigint>, v string")
    got = sorted(tuple(r) for r in mtree.top_k(df, df.id % 50 == 0).collect())
    assert got == brute_top(rows)


def test_top_k_edge_cases(spark):
    from ctxspark.llm.mtree import top_k

    schema = "id bigint, vector array<bigint>"
    df = spark.createDataFrame([(0, [1, 2]), (1, None), (2, [None, 1]), (3, [5]), (None, [1, 1]), (4, []), (50, [0, 0])], schema)
    got = sorted(tuple(r) for r in top_k(df, df.id % 50 == 0).collect())
    assert got == [(0, 1, 3, 5), (0, 2, 4, 0), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 3, 0), (50, 3, 4, 0)]
    assert top_k(df.limit(0), df.id % 50 == 0).count() == 0


def test_tree_skips_distances():
    from ctxspark.llm.mtree import MTree, Space

    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (20, 6))
    v = centers[rng.integers(0, 20, 500)] + rng.integers(-4, 5, (500, 6))
    tree = MTree(np.arange(500), v, Space(float((v.astype(float) ** 2).sum(1).max())))
    tree.search(v[:20], np.full(20, -1), 5, np.full(20, -np.inf))
    assert tree.computed < 20 * 500 * 0.7


def test_whole_trees_are_skipped(spark, monkeypatch):
    from ctxspark.llm import mtree

    monkeypatch.setattr(mtree, "SHARD", 64)
    rng = np.random.default_rng(8)
    centers = rng.integers(-4000, 4000, (25, 8))
    v = centers[rng.integers(0, 25, 2500)] + rng.integers(-5, 6, (2500, 8))
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, "id bigint, vector array<bigint>").repartition(5)
    assert sorted(tuple(r) for r in mtree.top_k(df, df.id % 50 == 0).collect()) == brute_top(rows)
    work = mtree.top_k(df, df.id % 50 == 0, report=True).collect()
    assert len(work) == 50 and np.mean([r.trees for r in work]) < 0.3 * 2500 / 64 and np.mean([r.computed for r in work]) < 0.3 * 2500


def test_products_that_may_not_fit_raise(spark):
    from ctxspark.llm.mtree import top_k

    df = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 1]), (2, [3, 3])], "id bigint, vector array<bigint>")
    with pytest.raises(ValueError, match="64 bits"):
        top_k(df, df.id % 50 == 0)
    assert top_k(df.where("id <> 0"), df.id == 2).count() == 1


# pipeline


def test_pipeline_stages(spark, edge, nothing):
    import corpus_pipeline as P

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "best-fit packing"]
    for df in (edge.select(columns), nothing.select(columns), spark.read.parquet(f"{SF}/documents.parquet")):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == columns and out.dtypes == df.dtypes, name
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in df.collect()}
        assert P.packing(spark, df, SF).count() >= df.count()


def firsts(rows, simhash):
    """Of the groups that links by fingerprint (given) or by a five-word Jaccard similarity of 0.8 make: the first ids."""
    from tests.llm.test_near_dedup_stage import grams, jaccard

    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)

    for i, _, c in simhash:
        join(i, c)
    sets = [(i, grams(t)) for i, t in rows if t and t.split()]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 0.8 * len(a) <= len(b) <= len(a) / 0.8 and jaccard(a, b) >= 0.8:
                join(i, j)
    return {find(i) for i in low}


def test_pipeline_against_brute_force(spark):
    """Stage by stage, with plain versions of what each keeps."""
    import corpus_pipeline as P
    from ctxspark.llm.decontam import words_of
    from tests.llm.test_text_operators import brute_lines, brute_simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = P.toxicity(spark, docs, SF).cache()
    lines = brute_lines([(r.doc_id, r.text, r.source) for r in clean.collect()], 10)
    kept = P.line_dedup(spark, clean, SF).cache()
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(k[0], k[3]) for k in lines} and all(r.n_chars == len(r.text) for r in kept.collect())
    unique = P.near_dedup(spark, kept, SF).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in unique.collect()) == sorted(firsts(rows, brute_simhash(rows)))

    def leaks(words):
        grams = {tuple(words[k : k + 5]) for k in range(len(words))}
        return any(len(own & grams) >= 0.8 * len(own) - 1e-9 for own in ({tuple(b[k : k + 5]) for k in range(len(b) - 4)} for b in bench))

    left = P.decontamination(spark, unique, SF)
    want = {r.doc_id for r in unique.collect() if not leaks(words_of(r.text.encode()))}
    assert {r.doc_id for r in left.collect()} == want
    assert {r.doc_id for r in P.run(spark, SF).collect()} == want
