"""Texts linked by the Jaccard similarity of word shingles: MinHash bands propose, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import bound_arrow, cut, mix, ngram_hash, text_slices
from ctxspark.llm.components import components
from ctxspark.llm.fmindex import HASHED_BYTES, HashedWords, NameFilter

SHINGLE = 5
SIMILARITY = 0.8
#: A band is the minima of ROWS permutations. At a similarity of 0.8 two texts share none of the bands once in 150,000 times.
ROWS, BANDS = 5, 30
#: Texts of one side of a task, and distinct shingles that are compared at a time.
BLOCK = 256
_COLUMNS = 1 << 15
#: Words of more bytes are hashed by XXH64: the sum of powers that serves the others is weak on long words.
LONG_WORD = 64

_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(_FACTORS + np.uint64(77))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct runs of words (the whole sequence if shorter), case folded."""
    w = HashedWords([t.lower() for t in texts])
    h = w.hash
    for k in np.flatnonzero(w.end - w.start > LONG_WORD).tolist():
        h[k] = xxhash.xxh64_intdigest(w.raw[w.start[k] : w.end[k]])
    size = np.diff(np.append(w.begin, len(h)))
    return [np.unique(ngram_hash(h[b : b + n], min(shingle, n))) if n else h[:0] for b, n in zip(w.begin.tolist(), size.tolist())]


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A number that stands for each set."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x BANDS): per band a hash of its number and its minima. No set may be empty."""
    n = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.cumsum(n) - n
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS):
        out[:, k] = k + 1
        for r in range(k * ROWS, (k + 1) * ROWS):
            out[:, k] = mix(out[:, k] * np.uint64(0x100000001B3) + np.minimum.reduceat(flat * _FACTORS[r] + _SHIFTS[r], at))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, keys): one row per row of docs that has words; node stands for its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, limit=HASHED_BYTES):
            sets = shingle_sets(texts)
            some = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in some]
            keys = band_keys(sets).view(np.int64) if sets else np.empty((0, BANDS), np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some, pa.int64())), pa.array(node_of(sets)), listed], ["id", "node", "keys"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node long, keys array<long>")


def sets_of(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the texts whose node is in nodes, one row each, and perhaps of a few more."""
    wanted = docs.sparkSession.sparkContext.broadcast(NameFilter.of(nodes.select(F.col("node").alias("name")), nodes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, limit=HASHED_BYTES):
            sets = [s for s in shingle_sets(texts) if len(s)]
            node = node_of(sets)
            at = np.flatnonzero(wanted.value.has(node.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([sets[i].tobytes() for i in at.tolist()], pa.binary())], ["node", "shingles"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, shingles binary")
    return cut(found.groupBy("node").agg(F.first("shingles").alias("shingles")))


def similar(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs with at least that Jaccard similarity."""
    sets = left + right
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[column]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(left), len(right)))
    for a in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        i, j = np.searchsorted(place, [a, a + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, int(place[j - 1]) - a + 1)), np.float32)
        m[owner[i:j], place[i:j] - a] = 1
        shared += m[: len(left)] @ m[len(left) :].T
    return np.nonzero(shared >= least * (n[: len(left), None] + n[None, len(left) :] - shared) - 1e-9)


def _solved(units: DataFrame, keys: list[str], least: float) -> DataFrame:
    """units (keys, right, node, root, shingles) to (a, b): the pairs of a left and a right node in one unit that are as
    similar as that, unless they have one root already."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [{x[1]: x for x in rows if x[0] == side} for side in (False, True)]
        left, right = (list(s.values()) for s in sides)
        if not left or not right:
            return
        i, j = similar(*([np.frombuffer(x[3], np.uint64) for x in side] for side in (left, right)), least)
        pairs = [(left[p][1], right[q][1]) for p, q in zip(i.tolist(), j.tolist()) if left[p][2] != right[q][2]]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, unit in groupby(rows, lambda row: row[: len(keys)]):  # rows come sorted by unit
            yield from solve([row[len(keys) :] for row in unit])

    dealt = units.select(*keys, "right", "node", "root", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def hub_links(pairs: DataFrame, texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """pairs (node, hub) to (a, b): those that are similar. A hub's nodes are dealt out by blocks, each with the hub."""
    sizes = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks")).cast("int")
    nodes = pairs.join(sizes, "hub").select("hub", mine.alias("i"), F.lit(True).alias("right"), "node").join(texts, "node")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(False).alias("right"), F.col("hub").alias("node")).join(texts, "node")
    return _solved(nodes.unionByName(hubs).withColumn("root", F.col("node")), ["hub", "i"], least)


def rest_links(buckets: DataFrame, texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """buckets (key, node, root, rest) to (a, b): the pairs of a bucket's rest and any other node of it with another root
    that are similar. Both sides are cut into blocks, and each pair of blocks is a task's unit."""
    sizes = cut(buckets.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks")).cast("int")
    dealt = buckets.join(sizes, "key").withColumn("mine", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt.select("key", F.col("mine").alias("i"), F.col("o").alias("j"), F.lit(False).alias("right"), "node", "root")
    right = dealt.where("rest").select("key", F.col("o").alias("i"), F.col("mine").alias("j"), F.lit(True).alias("right"), "node", "root")
    return _solved(left.unionByName(right).join(texts, "node"), ["key", "i", "j"], least)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, low): per row of docs that has words the smallest id among the rows that chains of similar texts reach.

    Texts that share a band's key are candidates. Each is first compared with the hub of its bucket, the smallest node,
    which settles tight groups of any size by as many comparisons as members. Only nodes that this leaves apart from
    their bucket's hub are then compared with all of the bucket, so no pair of candidates goes unjudged unless a chain
    of links joins it already."""
    rows = cut(sketches(docs, id_col, text_col))
    keyed = cut(rows.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key")))
    hubs = cut(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    met = cut(keyed.join(hubs, "key"))
    pairs = cut(met.where("node <> hub").select("node", "hub").distinct())
    texts = sets_of(docs, text_col, pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct())
    star = cut(components(hub_links(pairs, texts, least)))
    # a bucket of two is settled by its hub
    many = met.where("n > 2").join(star.select("node", "root"), "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root"))
    many = cut(many.join(star.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left"))
    many = many.select("key", "node", "root", (F.col("root") != F.coalesce("hub_root", "hub")).alias("rest"))
    mixed = cut(many.groupBy("key").agg(F.max("rest").alias("some")).where("some").select("key"))
    late = cut(rest_links(many.join(mixed, "key"), texts, least))
    named = rows.select("id", "node").join(star.select("node", "root"), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    if late.isEmpty():
        named = cut(named)
    else:
        root = star.select("node", F.col("root").alias("r"))
        both = late.join(root.withColumnsRenamed({"node": "a", "r": "ra"}), "a", "left").join(root.withColumnsRenamed({"node": "b", "r": "rb"}), "b", "left")
        joined = cut(components(both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        named = cut(named.join(joined, "root", "left").select("id", "node", F.coalesce("top", "root").alias("root")))
    low = cut(named.groupBy("root").agg(F.min("id").alias("low")))
    return named.join(low, "root").select("id", "low")
