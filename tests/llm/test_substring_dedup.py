"""Repeated passages against brute force: the index, the operator, and rows that are hard to tell apart."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import texts


def brute_passages(rows, window=20):
    rows = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            at = (i is not None, i or 0, k)
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, at), at)
    out = Counter()
    for i, w in rows:
        gone = {k + d for k in range(len(w) - window + 1) for d in range(window) if i is not None and first[tuple(w[k : k + window])] < (True, i, k)}
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def dedup(df):
    from ctxspark.llm.fmindex import dedup_passages

    return Counter((r.id, r.n_words, r.n_removed, r.kept) for r in dedup_passages(df).collect())


def test_substring_dedup(spark, edge, nothing, real):
    for df in (edge, real):
        assert dedup(df) == brute_passages(texts(df))
    assert not dedup(nothing)


def test_string_ids(spark):
    text = " ".join(f"w{k}" for k in range(25))
    got = dedup(spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string"))
    assert {(i, n) for i, _, n, _ in got} == {(None, 0), ("a", 25), ("b", 25)}


def test_frequent_passages(spark, monkeypatch):
    """A passage in many texts, with other words around it, and a periodic text."""
    from ctxspark.llm import fmindex

    r = random.Random(2)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 400))
    passage = [word() for _ in range(26)]
    rows = [(i, " ".join([word() for _ in range(9)] + passage[i % 3 : 24 + i % 3] + [word() for _ in range(7)])) for i in range(300)]
    rows += [(900, "x y " * 40), (901, "x y " * 15), (902, "z " * 21), (903, "z " * 20), (904, "p q r " * 90), (905, "q r p " * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(fmindex, "FREQUENT", 50)
    assert dedup(df) == brute_passages(rows)
    monkeypatch.setattr(fmindex, "FREQUENT", 10**9)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 500)
    assert dedup(df) == brute_passages(rows)


def test_ids_that_repeat_with_unlike_texts(spark):
    r = random.Random(4)
    a, b, c = ([f"{x}{r.randrange(10**6)}" for _ in range(30)] for x in "abc")
    rows = [(1, a + b), (7, c + a), (7, a[:22]), (7, ["x"] * 3 + c + b), (7, ["x"] * 3 + c + b), (7, []), (8, c[:21]), (None, b), (None, a)]
    rows = [(i, " ".join(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert dedup(df) == brute_passages(rows)


def thue_morse(n, swap):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join("ab"[x ^ swap] for x in out)


def test_words_of_equal_hash_are_not_equal(spark):
    """Unlike words that any hash by powers modulo 2^64 takes for one."""
    from ctxspark.llm.fmindex import HashedWords

    x, y = thue_morse(1024, 0), thue_morse(1024, 1)
    assert x != y and len(set(HashedWords([f"{x} {y}".encode()]).hash.tolist())) == 1
    body = [f"w{k}" for k in range(19)]
    rows = [(k, " ".join(t)) for k, t in enumerate([[*body, x], [*body, y], [x, *body], [y, *body], [*body, x, "z"], [y] * 21, [x] * 21])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dedup(df)
    assert got == brute_passages(rows) and sorted(n for _, _, n, _ in got) == [0, 0, 0, 0, 20, 20, 20]


def indexed(seed, window):
    rng = np.random.default_rng(seed)
    symbols, parts = [2, 3, 5, 30][seed % 4], []
    for _ in range(int(rng.integers(1, 50))):
        p = rng.integers(1, symbols + 1, int(rng.integers(window, 64))).tolist()
        if parts and rng.random() < 0.5:
            q = parts[int(rng.integers(len(parts)))]
            p = (p[:10] + q[int(rng.integers(0, max(1, len(q) - window))) :])[:63]
        if p not in parts and len(p) >= window:
            parts.append(p)
    return parts


@pytest.mark.parametrize("window", [3, 20])
@pytest.mark.parametrize("seed", range(12))
def test_windows_that_begin_earlier(seed, window):
    from ctxspark.llm.fmindex import earlier_windows

    parts = indexed(seed, window)
    order = np.arange(len(parts), dtype=np.int64) // 2
    start = np.arange(len(parts), dtype=np.int64) % 2 * (seed % 9)
    found = earlier_windows([b" ".join(b"w%d" % x for x in p) for p in parts], order, start, window)
    got = {(k, a + i) for k, a, n in found for i in range(n - window + 1)}
    first = {}
    for k, p in enumerate(parts):
        for i in range(len(p) - window + 1):
            g, at = tuple(p[i : i + window]), (order[k], start[k] + i)
            first[g] = min(first.get(g, at), at)
    assert got == {(k, i) for k, p in enumerate(parts) for i in range(len(p) - window + 1) if first[tuple(p[i : i + window])] < (order[k], start[k] + i)}


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics(seed):
    from ctxspark.llm.fmindex import FMIndex

    parts = indexed(seed, 4)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    text = np.concatenate([[*p, 0] for p in parts]).astype(np.int32)
    length, _ = FMIndex(text, np.arange(len(text)), 4).statistics(text, begin, size, whole=True)
    occurs = Counter(tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    for b, p in zip(begin.tolist(), parts):
        for i in range(len(p)):
            want = max((m for m in range(len(p) - i + 1) if m == 0 or occurs[tuple(p[i : i + m])] > 1), default=0)
            assert length[b + i] == want


def test_digest_matches_kept_words(spark, real):
    from ctxspark.llm.fmindex import dedup_passages

    r = dedup_passages(real).withColumn("d", F.sha2("kept", 256)).where("n_removed > 0").first()
    assert r.d == hashlib.sha256(r.kept.encode()).hexdigest()


def test_words_found_in_numpy(edge):
    from ctxspark.llm.fmindex import HashedWords

    rows = [(t or "").encode() for _, t in texts(edge)]
    for part in (rows, rows[:1], [b""], [b"", b" ", b""], [b"a", b"", b"a b\x0bc\x1cd a", b"x  y\n\nz"]):
        w = HashedWords(part)
        flat = [(i, x) for i, t in enumerate(part) for x in t.split()]
        assert w.owner.tolist() == [i for i, _ in flat]
        assert w.words(np.arange(len(flat)), np.ones(len(flat), np.int64)) == [x for _, x in flat]
        assert len(set(zip(w.hash.tolist(), (x for _, x in flat)))) == len({x for _, x in flat}) == len(set(w.hash.tolist()))
        assert all(w.owner[b] == i for i, b in enumerate(w.begin.tolist()) if part[i].split())
        for i, b in enumerate(w.begin.tolist()):
            n = len(part[i].split())
            if n:
                assert w.words(np.array([b]), np.array([n])) == [b" ".join(part[i].split())]
