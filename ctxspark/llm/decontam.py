"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ctxspark.llm.common import WordHash, bound_arrow, cut, ngram_hash, text_slices
from ctxspark.llm.fmindex import NameFilter

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of test items that are broadcast at most; beyond, items and documents meet in a shuffle.
ITEM_BYTES = 32 << 20
_FILTER_BITS = 22

#: Words: runs of ASCII letters (case folded) and digits and of anything beyond ASCII.
_FOLD = bytes(c if 0x30 <= c < 0x3A or 0x61 <= c < 0x7B or c >= 0x80 else c + 0x20 if 0x41 <= c < 0x5B else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingles_of(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(n))))


def sketched(words: list[bytes], shingle: int, containment: float, hash_of: WordHash) -> tuple[int, set, np.ndarray]:
    """(words of a shingle, distinct shingles, sketch) of an item that has words; see ItemIndex."""
    n = min(shingle, len(words))
    own = shingles_of(words, n)
    upper = 1 << (len(own) - 1).bit_length()
    size = min(len(own), upper - ceil(containment * upper) + 1)
    return n, own, np.unique(ngram_hash(hash_of.of(words), n))[:size]


def contains(own: set, text: set, containment: float) -> int:
    """The shingles shared, if they are enough, else 0."""
    shared = len(own & text)
    return shared if shared >= ceil(containment * len(own) - 1e-9) else 0


class ItemIndex:
    """Test items by size. An item's partition is the power of two that bounds its number of distinct shingles; all of
    a partition keep a MinHash sketch of the same size, their so many smallest shingle hashes. The size is one more
    than the shingles that an item of that partition may lack at the threshold, so a document that contains enough of
    an item shares a hash with its sketch for certain: the search loses nothing. An item shorter than a shingle is one
    shingle of its own length."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, containment: float = CONTAINMENT):
        self.containment, hash_of = containment, WordHash()
        self.items, by_hash = [], defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            if words := words_of(text):
                n, own, sketch = sketched(words, shingle, containment, hash_of)
                for h in sketch.tolist():
                    by_hash[n][h].add(len(self.items))
                self.items.append((item_id, n, own))
        self.hashes = {n: np.array(sorted(x), np.uint64) for n, x in by_hash.items()}
        self.owners = {n: {h: sorted(x) for h, x in own.items()} for n, own in by_hash.items()}
        self.filters = {}
        for n, h in self.hashes.items():
            self.filters[n] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[n][h >> np.uint64(64 - _FILTER_BITS)] = True

    def search(self, docs: list[list[bytes]], hash_of: WordHash) -> Iterator[tuple[int, int, int]]:
        """(document's place, item's place, shingles shared) of all pairs at the threshold."""
        count = np.fromiter(map(len, docs), np.int64, len(docs))
        owner = np.repeat(np.arange(len(docs)), count)
        h = np.concatenate([hash_of.of(w) for w in docs]) if len(docs) else np.empty(0, np.uint64)
        pairs = set()
        for n, sketch in self.hashes.items():
            grams = ngram_hash(h, n)
            at = np.flatnonzero(self.filters[n][grams >> np.uint64(64 - _FILTER_BITS)])
            at = at[owner[at] == owner[at + n - 1]]
            near = np.minimum(np.searchsorted(sketch, grams[at]), len(sketch) - 1)
            for i in at[sketch[near] == grams[at]].tolist():
                pairs.update((int(owner[i]), k) for k in self.owners[n][int(grams[i])])
        had: dict = {}
        for d, k in sorted(pairs):
            _, n, own = self.items[k]
            if (d, n) not in had:
                had = {(d, n): shingles_of(docs[d], n)}
            if shared := contains(own, had[d, n], self.containment):
                yield d, k, shared


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null and item is not null")


def _held(items: DataFrame, most: int) -> list[tuple] | None:
    """The items, if they have no more bytes than that."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most:
        return None
    return [(r.item, r.text.encode()) for r in items.collect()]


def _meet(docs: DataFrame, items: DataFrame, shingle: int, containment: float) -> DataFrame:
    """docs (at, text), each row with a number of its own, and items (item, text) to (at, item, n_shingles, n_shared): as
    with ItemIndex, but item sketches and the documents' shingle hashes meet in a shuffle, by shingle length and hash.
    A bounded filter of the sketches spares all other shingles the way; it has no false negatives. Pairs that share a
    hash are verified next to the document's text, one after the other."""
    spark = docs.sparkSession
    items = cut(items.select(F.monotonically_increasing_id().alias("row"), "item", "text"))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = WordHash()
        for rows, texts in text_slices(batches):
            row, size, name = [], [], []
            for r, t in zip(rows.column("row").to_pylist(), texts):
                if words := words_of(t):
                    n, _, sketch = sketched(words, shingle, containment, hash_of)
                    row += [r] * len(sketch)
                    size += [n] * len(sketch)
                    name.append(sketch)
            names = np.concatenate(name) if name else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(size, pa.int32()), pa.array(names.view(np.int64))], ["row", "n", "name"])

    held = cut(items.select("row", "text").mapInArrow(sketches, "row long, n int, name long"))
    sizes = sorted(r.n for r in held.select("n").distinct().collect())  # at most shingle numbers
    wanted = spark.sparkContext.broadcast(NameFilter.of(held.select("name").distinct(), held.count()))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = WordHash()
        for rows, texts in text_slices(batches):
            at, size, name = [], [], []
            for r, t in zip(rows.column("at").to_pylist(), texts):
                h = hash_of.of(words_of(t))
                for n in sizes:
                    grams = np.unique(ngram_hash(h, n))
                    grams = grams[wanted.value.has(grams)]
                    at += [r] * len(grams)
                    size += [n] * len(grams)
                    name.append(grams)
            names = np.concatenate(name) if name else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(names.view(np.int64))], ["at", "n", "name"])

    pairs = docs.mapInArrow(hits, "at long, n int, name long").join(held, ["n", "name"]).select("at", "row").distinct()
    pairs = cut(pairs.join(items, "row").select("at", "item", F.col("text").alias("own")))
    texts = docs.join(pairs.select("at").distinct(), "at", "left_semi")
    kind = items.schema["item"].dataType
    units = texts.select("at", F.lit(None).cast(kind).alias("item"), F.lit(None).cast("string").alias("own"), "text").unionByName(pairs.withColumn("text", F.lit(None).cast("string")))
    units = units.repartition("at").sortWithinPartitions("at", F.col("text").isNull())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict = {}
        for b in batches:  # each document's text comes before its pairs
            out: list[tuple[int, int, int]] = []
            texts, owns = b.column("text").to_pylist(), b.column("own").to_pylist()
            for i, (text, own) in enumerate(zip(texts, owns)):
                if own is None:
                    had = {0: words_of(text.encode())}
                    continue
                words = words_of(own.encode())
                n = min(shingle, len(words))
                if n not in had:
                    had[n] = shingles_of(had[0], n)
                grams = shingles_of(words, n)
                if shared := contains(grams, had[n], containment):
                    out.append((i, len(grams), shared))
            i, size, shared = (pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], [])))
            yield pa.RecordBatch.from_arrays([b.column("at").take(i), b.column("item").take(i), size, shared], ["at", "item", "n_shingles", "n_shared"])

    return units.mapInArrow(verify, f"at long, item {kind.simpleString()}, n_shingles long, n_shared long")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(id, item, n_shingles, n_shared, containment): one row per document row and test item of which the document
    holds at least that share of the distinct word shingles; several rows of one item id count each for themselves.
    Items of up to item_bytes are broadcast, and documents are searched where they lie; more items meet the documents in
    a shuffle, with the same result. Null or wordless texts and items, and null item ids, match nothing; an empty table
    gives an empty result."""
    spark = docs.sparkSession
    bound_arrow(spark)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (items, item_col))]
    docs, items = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _items(items, item_col, item_text)
    block = _held(items, item_bytes)
    if block is None:
        docs = cut(docs.withColumn("at", F.monotonically_increasing_id()))
        met = _meet(docs.select("at", "text"), items, shingle, containment).join(docs.select("at", "id"), "at")
        return met.select("id", "item", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    held = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hash_of = ItemIndex(held.value, shingle, containment), WordHash()
        for rows, texts in text_slices(batches):
            hits = list(index.search([words_of(t) for t in texts], hash_of)) if index.items else []
            d, k, shared = (np.array(x, np.int64) for x in (zip(*hits) if hits else ([], [], [])))
            size = np.array([len(index.items[i][2]) for i in k.tolist()], np.int64)
            found = pa.array([index.items[i][0] for i in k.tolist()], arrow_item)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), found, pa.array(size), pa.array(shared), pa.array(shared / np.maximum(size, 1), pa.float64())], ["id", "item", "n_shingles", "n_shared", "containment"])

    arrow_item = to_arrow_type(items.schema["item"].dataType)
    return docs.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, n_shingles long, n_shared long, containment double")


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that contain no test item at the threshold. There is no shuffle but for
    items of more than item_bytes."""
    spark = docs.sparkSession
    bound_arrow(spark)
    items = _items(items, item_col, item_text)
    block = _held(items, item_bytes)
    if block is None:
        numbered = cut(docs.withColumn("__at", F.monotonically_increasing_id()))
        met = _meet(numbered.select(F.col("__at").alias("at"), F.col(text_col).alias("text")), items, SHINGLE, CONTAINMENT)
        return numbered.join(met.select(F.col("at").alias("__at")).distinct(), "__at", "left_anti").select(*docs.columns)
    held = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hash_of = ItemIndex(held.value), WordHash()
        for rows, texts in text_slices(batches, text_col):
            hits = {d for d, _, _ in index.search([words_of(t) for t in texts], hash_of)} if index.items else set()
            yield rows.filter(pa.array([i not in hits for i in range(len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
