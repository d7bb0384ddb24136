"""SimHash near-duplicates over a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import bound_arrow, cut, text_slices
from ctxspark.llm.components import components

#: Fingerprints of one side of a task, and entries of a leaf and of an inner node of the index.
BLOCK = 1024
FAN = 16
#: Up to so many distinct fingerprints, a key is one of d + 1 bands; beyond, two of d + 2, then three of d + 3.
WIDER_AT = (4_000_000, 2_000_000_000)


def fingerprint(words: list[bytes], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, space-joined (the whole sequence if shorter)."""
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    text, digest, at, ends = b" ".join(words), xxhash.xxh64_intdigest, 0, []
    for w in words:
        at += len(w) + 1
        ends.append(at - 1)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    return np.array([digest(text[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each list of hashes: the bits set in over half of them; zero if it is empty."""
    out = np.zeros(len(hashes), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if full:
        n = np.array([len(hashes[i]) for i in full])
        ones = np.unpackbits(np.concatenate([hashes[i] for i in full]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(ones, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs; fp holds the unsigned 64 bits as a signed long. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            fps = majority([fingerprint(t.lower().split(), shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each word in the Gray order: the prefix XOR of its bits."""
    b = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        b ^= b >> np.uint64(s)
    return b


class GrayIndex:
    """Fingerprints in Gray order; neighbours share most bits. A leaf node holds FAN fingerprints and the bits they all
    share (mask, pattern); an upper node the bits that its leaves share. A leaf's own mask leaves out what its upper
    node already compares, and an entry's what its leaf compares, so differences add up along the path."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.leaf = self._shared(self.fps, FAN)
        self.upper = self._shared(self.fps, FAN * FAN)

    @staticmethod
    def _shared(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(fps), size)
        every, some = np.bitwise_and.reduceat(fps, at), np.bitwise_or.reduceat(fps, at)
        mask = ~(every ^ some)
        return mask, every & mask

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query places, entry places in self.fps) of all pairs that differ in at most that many bits."""
        q = np.repeat(np.arange(len(queries)), len(self.upper[0]))
        u = np.tile(np.arange(len(self.upper[0])), len(queries))
        d = np.bitwise_count((queries[q] ^ self.upper[1][u]) & self.upper[0][u])
        q, u, d = (x[d <= most] for x in (q, u, d))
        q, u, d, leaf = self._open(q, u, d, len(self.leaf[0]))
        rest = self.leaf[0][leaf] & ~self.upper[0][u]
        d = d + np.bitwise_count((queries[q] ^ self.leaf[1][leaf]) & rest)
        q, leaf, d = (x[d <= most] for x in (q, leaf, d))
        q, leaf, d, e = self._open(q, leaf, d, len(self.fps))
        d = d + np.bitwise_count((queries[q] ^ self.fps[e]) & ~self.leaf[0][leaf])
        return q[d <= most], e[d <= most]

    @staticmethod
    def _open(q: np.ndarray, node: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        there = child < n
        return *(np.repeat(x, FAN)[there] for x in (q, node, d)), child[there]


def forest(left: np.ndarray, right: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint reached) by links within left, or between left and right."""
    index = GrayIndex(left)
    parts = []
    queries = index.fps if right is None else right
    for k in range(0, len(queries), 256):
        q, e = index.search(queries[k : k + 256], most)
        parts.append((q + k, e))
    q, e = (np.concatenate(x) for x in zip(*parts))
    nodes, flat = np.unique(np.concatenate([queries[q].view(np.int64), index.fps[e].view(np.int64)]), return_inverse=True)
    a, b = flat[: len(q)], flat[len(q) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def band_keys(fp, bands: int, take: int) -> list:
    """The key columns: for each choice of bands, its number and its bits. Two fingerprints with at most bands - take
    differing bits agree in one of them."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(bands), take)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("v")))
    return out


def link_forest(fps: DataFrame, most: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all distinct values of fps.fp within so many differing bits into the components that
    all links would make. Fingerprints that share a key of band_keys meet; keys with over block of them are cut into
    blocks by hash, and each pair of blocks is a task's unit, so none grows with a key. Each unit builds the Gray
    index of one block and searches it with the other; only a spanning forest leaves it."""
    n = fps.count()
    take = 1 + sum(n > x for x in WIDER_AT)
    keyed = fps.select("fp", F.explode(F.array(*band_keys(F.col("fp"), most + take, take))).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut(sizes.select("k", "v", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    plain = F.col("blocks") == 1
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("blocks")).cast("int")
    dealt = keyed.join(sizes, ["k", "v"]).withColumn("mine", mine)
    other = F.explode(F.when(plain, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.withColumn("o", other).select("k", "v", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), (F.col("mine") > F.col("o")).alias("right"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [t.column(c).to_numpy() for c in ("k", "v", "i", "j")]
            right, fp = t.column("right").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if len(fp) else []
            cuts = [0, *np.asarray(new).tolist(), len(fp)]
            out = [np.empty((2, 0), np.int64)]
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    r = right[a:b]
                    if cols[2][a] == cols[3][a]:
                        found = forest(fp[a:b], None, most)
                    elif r.any() and not r.all():
                        found = forest(fp[a:b][~r], fp[a:b][r], most)
                    else:
                        continue
                    out.append(np.stack(found)[:, found[0] != found[1]])
            pairs = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:  # rows come sorted by unit; the last unit of a batch may go on in the next
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held)
            cols = [t.column(c).to_numpy() for c in ("k", "v", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols])) if t.num_rows else []
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield from solve(t.slice(0, at))
            held = [t.slice(at)]
        if held:
            yield from solve(pa.concat_tables(held))

    return units.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """(id, fp, component): per row of docs its fingerprint and the smallest id among all rows whose fingerprints are
    reachable by links of at most that many differing bits, itself included.

    Null or wordless texts have fingerprint zero and link like any other; rows with a null id take part, but a null id
    is never a component's name (a component of null ids only has none). Repeated rows stay repeated. Other columns of
    docs are not read. An empty table gives an empty result."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    groups = cut(components(link_forest(distinct.select("fp"), most)))
    of = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of = cut(of)
    low = of.groupBy("root").agg(F.min("low").alias("component"))
    named = cut(of.select("fp", "root").join(cut(low), "root").select("fp", "component"))
    return fps.join(named, "fp").select("id", "fp", "component")
