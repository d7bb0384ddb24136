"""The pipeline's near dedup against exact five-word Jaccard similarity."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tests.llm.conftest import sentence


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_texts_of_similarity_08_are_one_document(spark):
    import corpus_pipeline as P

    r = random.Random(3)
    texts = []
    for k in range(30):
        words = [f"{w}{r.randrange(40)}" for w in sentence(r, 240).split()]
        texts.append(words)
        for cut in (4, 9, 20):  # words changed apart: each takes five shingles
            copy = words[:]
            for at in range(7, 7 + 6 * cut, 6):
                copy[at] = f"new{k}"
            texts.append(copy)
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(texts)]
    sets = [grams(t) for _, t, *_ in rows]
    near = {(a, b) for a, b in combinations(range(len(rows)), 2) if jaccard(sets[a], sets[b]) >= 0.8}
    assert 30 <= len(near) < 180
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {x.doc_id for x in P.near_dedup(spark, docs, "").collect()}
    assert not [p for p in near if set(p) <= kept]
    reached = {b for _, b in near}
    far = {i for i in range(len(rows)) if all(jaccard(sets[i], sets[j]) < 0.6 for j in range(i))}
    assert far - reached <= kept and len(far) >= 30


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def variants(seed):
    """Families of texts whose members differ by more and more words, with texts that share half of theirs."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 30, 60, 200]))]
        for _ in range(r.choice([1, 4, 25])):
            copy = base[:]
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            out.append(copy)
            base = copy if r.random() < 0.3 else base
    shared = [word() for _ in range(40)]
    out += [shared + [word() for _ in range(r.choice([4, 40]))] for _ in range(30)]
    r.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 8), (3, 8)])
def test_chains_of_similar_texts(spark, monkeypatch, seed, block):
    from ctxspark.llm import minhash

    monkeypatch.setattr(minhash.hub_links, "__defaults__", (block,))
    monkeypatch.setattr(minhash.rest_links, "__defaults__", (block,))
    texts = variants(seed)
    sets = [grams(t) for t in texts]
    low = list(range(len(texts)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert {r.id: r.low for r in minhash.similar_texts(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_unlike_texts_of_one_id_are_kept(spark):
    import corpus_pipeline as P

    r = random.Random(9)
    a, b, c = (" ".join(f"{r.choice('xyz')}{r.randrange(500)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a), (7, b), (7, c), (7, c), (7, a), (8, b), (None, c), (None, c), (9, None), (10, ""), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect())
    assert got == Counter([(1, a), (7, b), (7, c), (None, c), (None, c), (9, None)])


def test_nothing_to_link(spark):
    from ctxspark.llm.minhash import similar_texts

    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x y z w v u t")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in similar_texts(df).collect()) == [(1, 1), (4, 4)]
    assert similar_texts(df.limit(0)).count() == 0


def test_scratch_of_a_scope_goes_with_it(spark):
    import os

    from ctxspark.llm.common import cut, scratch_scope

    outer = cut(spark.range(3))
    with scratch_scope(spark):
        inner = cut(spark.range(4))
        kept = cut(inner, outside=True)
        with scratch_scope(spark):
            deep = cut(kept)
        assert not os.path.exists(deep.scratch_path) and os.path.exists(inner.scratch_path)
    assert not os.path.exists(inner.scratch_path) and outer.count() == 3 and kept.count() == 4
