"""Each operator against a brute-force version, on edge cases and on real rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1: token counts


def test_token_spans_and_rules(spark, edge, nothing):
    from tokenizers import Tokenizer

    from ctxspark.llm.attribution import RULES, allocate, line_sections, section_tokens, token_spans
    from ctxspark.llm.bpe import encoder, vocabulary_path

    bpe, own = encoder(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    for t in ["", " a", "a  b \n c", "<|endoftext|>\nx", "　a b\x1c c", *[t for _, t in texts(edge) if t and len(t) < 9000]]:
        ids = np.frombuffer(bpe.ids(t), "<u4")
        e = own.encode(t, add_special_tokens=False)
        assert ids.tolist() == e.ids
        a, b = token_spans(ids, bpe.sizes, t.encode())
        assert [tuple(map(int, x)) for x in zip(a, b)] == e.offsets
        if not t:
            continue
        s, f = line_sections(t)
        for rule in RULES:
            want = {"share": lambda x, y: sum(max(0, min(y, q) - max(x, p)) / (q - p) for p, q in e.offsets), "first": lambda x, y: sum(x <= p < y for p, q in e.offsets), "middle": lambda x, y: sum(x <= (p + q - 1) // 2 < y for p, q in e.offsets)}[rule]
            assert np.allclose(allocate(a, b, s, f, rule), [want(x, y) for x, y in zip(s, f)])
    got = defaultdict(float)
    for r in section_tokens(edge).collect():
        got[r.id] += r.n_tokens
    assert got[1] == len(own.encode(texts(edge)[0][1]).ids) and 5 not in got and 4 not in got
    assert section_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        section_tokens(edge, rule="other")


# 3: license scan


def test_license_scan(spark, edge, nothing, real):
    from ctxspark.llm.licenses import PHRASES, scan

    lines = [(100, "Under the  MIT-License and under the mit license, CC BY NC", "en", "a"), (101, "this work is licensed under the GNU general public license version 3 " + "x " * 200, "en", "a"), (102, "x " * 90 + "Licensed under the Apache License, Version 2.0 " + "y " * 90, "en", "a"), (103, "apache license version 2 " * 2, "en", "a")]
    extra = spark.createDataFrame(lines, "doc_id bigint, text string, lang string, source string")
    got = {r.id: r for r in scan(extra).collect()}
    assert got[100].base_labels == "cc-by-nc,mit" and got[100].n_base == 3 and (got[100].first_word, got[100].last_word) == (0, 9)
    assert got[101].labels == "gpl-3" and got[101].base_labels == "" and got[102].labels == "apache-2" and got[103].n_base == 2
    for df in (edge, real):
        want = Counter()
        for i, t in texts(df):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = sorted((k, label) for p, label in PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            want[i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))] += 1
        rows = scan(df).collect()
        assert Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert scan(nothing).count() == 0


# 4: packing


def test_packing(spark, edge, nothing, real):
    from tokenizers import Tokenizer

    from ctxspark.llm.bpe import vocabulary_path
    from ctxspark.llm.packing import CAPACITY, pack

    own = Tokenizer.from_file(vocabulary_path())
    for df in (edge, real):
        want, total = Counter(), 0
        for i, t in texts(df):
            ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            total += len(ids)
            cuts = [0, *range(len(ids) % CAPACITY or CAPACITY, len(ids) + 1, CAPACITY)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        rows = pack(df).collect()
        assert Counter((r.id, r.piece, r.start, r.length, r.crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= CAPACITY
        assert len(bins) <= -(-total // CAPACITY) + max(2, 0.02 * len(bins))
    assert pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_size(seed):
    import random

    from ctxspark.llm.packing import Places, plan

    r = random.Random(seed)
    counts = Counter(r.choice([r.randint(1, 100), r.randint(1, 40), 34, 50, 51]) for _ in range(r.choice([1, 50, 3000])))
    patterns = plan(dict(counts), 100)
    packed = Counter()
    for p, bins in patterns:
        assert sum(s * k for s, k in p) <= 100 and sum(k for s, k in p if 3 * s > 100) <= 2
        for s, k in p:
            packed[s] += k * bins
    assert packed == counts
    assert sum(b for _, b in patterns) <= 1.1 * max(sum(s * n for s, n in counts.items()) / 100, sum(n for s, n in counts.items() if s > 50)) + 2
    places, taken = Places(patterns), set()
    for s, n in counts.items():
        q, o = places.of(np.full(n, s), np.arange(n))
        for x, y in zip(q.tolist(), o.tolist()):
            cells = {(x, y + d) for d in range(s)}
            assert not cells & taken
            taken |= cells


# 5: line dedup


def brute_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, line in enumerate((t.split("\n") if t is not None else [])):
            key = line.strip(" \t\r")
            if key:
                sites[key].add(s)
                at = (i is not None, i or 0, k)
                first[key] = min(first.get(key, at), at)
    out = Counter()
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if not (i is not None and x.strip(" \t\r") and len(sites[x.strip(" \t\r")]) >= min_sites and first[x.strip(" \t\r")] != (True, i, k))]
        out[i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 3, 10])
def test_line_dedup(spark, edge, nothing, real, min_sites):
    from ctxspark.llm.linededup import remove_boilerplate

    for df in (edge, real):
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in remove_boilerplate(df, min_sites=min_sites).collect())
        assert got == brute_lines(rows, min_sites)
    assert remove_boilerplate(nothing, min_sites=min_sites).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    from ctxspark.llm.linededup import remove_boilerplate

    rows = [(i, f"own {i}\nshared {n}", f"s{k}") for n in range(35, 45) for k in range(n) for i in [1000 * n + k]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Counter(r.doc_id // 1000 for r in remove_boilerplate(df, min_sites=40).where("n_removed > 0").collect())
    assert got == {n: n - 1 for n in range(40, 45)}


# 7: decontamination


def test_decontamination(spark, edge, nothing, real):
    from ctxspark.llm.decontam import contaminated, keep_uncontaminated, words_of

    passage = texts(edge)[8][1].split()[1:31]
    items = [(1, " ".join(passage)), (2, " ".join([*passage[:14], "other", *passage[15:]])), (3, "Word!"), (4, None), (5, "?"), (None, "word"), (6, "The the"), (7, "not to be found here at all")]
    items = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id bigint, text string, doc_id string")
    bench = real.sparkSession.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

    def brute(df, its):
        """(pairs, ids of the rows without any)"""
        out, clean, its = Counter(), Counter(), its.collect()
        for i, t in texts(df):
            w, found = words_of((t or "").encode()), 0
            for r in its:
                v = words_of((r.text or "").encode())
                n = min(5, len(v))
                if n and r.item_id is not None:
                    own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
                    hit = len(own & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
                    if hit >= 0.8 * len(own) - 1e-9:
                        out[i, r.item_id, len(own), hit] += 1
                        found += 1
            clean[i] += not found
        return out, +clean

    for df, its in ((edge, items), (real, bench)):
        want, clean = brute(df, its)
        assert want
        for size in (1 << 20, 100):  # items are broadcast, or meet the documents in a shuffle
            assert Counter((r.id, r.item, r.n_shingles, r.n_shared) for r in contaminated(df, its, item_bytes=size).collect()) == want
            kept = keep_uncontaminated(df, its, item_bytes=size)
            assert Counter(r.doc_id for r in kept.collect()) == clean and kept.columns == df.columns
    assert contaminated(nothing, items, item_bytes=1).count() == 0 and contaminated(edge, items.limit(0), item_bytes=-1).count() == 0
    assert contaminated(nothing, items).count() == 0 and contaminated(edge, items.limit(0)).count() == 0


# 9: SimHash


def brute_simhash(rows, most=4):
    fps = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    return Counter((i, f"{fps[k]:016x}", min(low[find(k)], default=None)) for k, (i, _) in enumerate(rows))


def test_simhash(spark, edge, nothing, real):
    from ctxspark.llm.simhash import near_duplicates

    for df in (edge, real):
        assert Counter((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in near_duplicates(df).collect()) == brute_simhash(texts(df))
    assert near_duplicates(nothing).count() == 0


@pytest.mark.parametrize(("block", "wider"), [(1024, None), (16, None), (64, (0, 10**9)), (64, (0, 0))])
def test_links_of_crowded_fingerprints(spark, monkeypatch, block, wider):
    from ctxspark.llm import simhash
    from ctxspark.llm.components import components

    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(60):
            x = int(s)
            for b in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    if wider:
        monkeypatch.setattr(simhash, "WIDER_AT", wider)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r.node: r.root for r in components(simhash.link_forest(df, 4, block)).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, u in zip(signed, fps):
        for b, v in zip(signed, fps):
            if a < b and (u ^ v).bit_count() <= 4:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    assert {x: got.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_gray_order():
    from ctxspark.llm.simhash import gray_rank

    codes = np.arange(64, dtype=np.uint64)
    assert gray_rank(codes ^ (codes >> np.uint64(1))).tolist() == list(range(64))


def test_components_of_a_chain(spark):
    from ctxspark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0
