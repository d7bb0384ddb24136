"""Best-fit packing of documents into token sequences, planned on the counts of piece sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.bpe import encoder, vocabulary_path
from ctxspark.llm.common import bound_arrow, cut, text_slices

CAPACITY = 2048
#: The id that ends a document.
END = 0
#: Rows of one size that are numbered together.
NUMBERED = 2000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, crc32): each document's ids and the end id, cut into pieces of capacity if they are
    more; then the first piece holds what is left over. A null text has the end id only."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = encoder(path), int(END).to_bytes(4, "little")
        for rows, texts in text_slices(batches):
            out = []
            for k, text in enumerate(texts):
                ids = bpe.ids(text.decode()) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                out += [(k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            k, *rest = (np.array(x, np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(k)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], ["id", "piece", "start", "length", "crc32"])

    bound_arrow(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns of sizes and how many bins have each: ((size, how many in a bin), ...), bins.

    Sizes above a third of the capacity come first: at most two go into a bin, each largest one with the largest
    partner that fits (a greedy matching). Smaller sizes then go, from the largest down, to the fullest bin that takes
    them, or to a new one. All items of a size are handled at once, so the work and the plan depend on the number of
    distinct sizes, capacity at most, and not on the number of documents."""
    left = {s: n for s, n in counts.items() if n}
    gaps: dict[int, list] = defaultdict(list)  # gap: [(pattern, bins)]
    order: list[int] = []

    def put(pattern, bins: int) -> None:
        gap = capacity - sum(s * k for s, k in pattern)
        if not gaps[gap]:
            insort(order, gap)
        gaps[gap].append((pattern, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b == a and left[a] < 2:
            b = large[k - 1] if k else None
        if b is None:
            put(((a, 1),), left[a])
            left[a] = 0
        elif a == b:
            put(((a, 2),), left[a] // 2)
            left[a] %= 2
        else:
            m = min(left[a], left[b])
            put(((a, 1), (b, 1)), m)
            left[a] -= m
            left[b] -= m
        large = [s for s in large if left[s]]
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                k = capacity // s
                if n >= k:
                    put(((s, k),), n // k)
                if n % k:
                    put(((s, n % k),), 1)
                break
            gap = order[at]
            pattern, bins = gaps[gap].pop()
            k = min(gap // s, n)
            m = min(bins, n // k)
            if bins > m:
                gaps[gap].append((pattern, bins - m))
            if not gaps[gap]:
                order.pop(at)
            put((*pattern, (s, k)), m)
            n -= m * k
    return [x for gap in order for x in gaps[gap]]


class Places:
    """Where the r-th piece of a size goes."""

    def __init__(self, patterns: list[tuple[tuple[tuple[int, int], ...], int]]):
        used: Counter = Counter()
        rows, base = defaultdict(list), 0
        for pattern, bins in patterns:
            offset = 0
            for s, k in pattern:
                rows[s].append((used[s], k, base, offset))
                used[s] += bins * k
                offset += s * k
            base += bins
        self.rows = {s: np.array(x, np.int64).T for s, x in rows.items()}

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset)"""
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            start, k, base, off = self.rows[s]
            at = np.searchsorted(start, rank[own], "right") - 1
            t = rank[own] - start[at]
            sequence[own], offset[own] = base[at] + t // k[at], off[at] + t % k[at] * s
        return sequence, offset


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (id, piece, start, length, crc32) with sequence_id and offset, packed gapless into sequences of capacity.

    The driver sees the number of items of each length only, capacity rows at most. Items of a length are numbered
    without a common order: each falls into a group by its hash, is numbered within that group, and adds what the
    groups before it hold."""
    spark = items.sparkSession
    sized = items.groupBy("length").agg(F.count("*").alias("n")).collect()
    held = spark.sparkContext.broadcast(plan({r.length: r.n for r in sized}, capacity))
    groups = sum(r.n for r in sized) // NUMBERED + 1
    dealt = items.withColumn("g", F.pmod(F.xxhash64("id", "piece", "crc32"), F.lit(groups)).cast("int"))
    held_by = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    base = cut(held_by.select("length", "g", F.coalesce(before, F.lit(0)).alias("base")))
    own = F.row_number().over(Window.partitionBy("length", "g").orderBy("id", "piece", "crc32")) - 1
    ranked = dealt.withColumn("own", own).join(base, ["length", "g"]).withColumn("rank", F.col("own") + F.col("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None
        for b in batches:
            places = places or Places(held.value)
            sequence, offset = places.of(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = [*items.columns, "sequence_id", "offset"]
    kind = items.schema["id"].dataType.simpleString()
    return ranked.select(*items.columns, "rank").mapInArrow(run, f"id {kind}, piece int, start long, length long, crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """All documents in sequences of at most capacity tokens: one row per piece, with its sequence and its offset there.
    Texts are encoded once; what the plan needs of them is kept in a shared scratch table. Null, empty and wordless
    texts are a piece of one token; null or repeated ids are documents like any other; an empty table packs to
    nothing. Other columns are not read."""
    return place(cut(pieces(docs, id_col, text_col, capacity, path)), capacity)
