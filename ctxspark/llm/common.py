"""What the training-data operators share: scratch tables, bounded Arrow slices, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Python step works on at a time, and that one Arrow batch holds at most.
SLICE_BYTES = 4 << 20
ARROW_BYTES = 16 << 20
#: Entries of a per-process memo (word to value) before it starts anew; it only saves time.
MEMO_ENTRIES = 600_000


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder. Only on a single machine, where none is named, a
    temporary folder is set; executors of a cluster would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ctxspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/llm/{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[tuple[str, ...]] = ContextVar("scope", default=())


def cut(df: DataFrame, outside: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: lineage ends there, so a lost executor
    costs no recomputation of what came before, and later readers see only the columns they use. Within a scratch_scope
    the table goes with the scope, unless it is written outside of it."""
    spark, scope = df.sparkSession, _SCOPE.get()
    path = "/".join([scratch_dir(spark), *(scope[:-1] if outside else scope), uuid.uuid4().hex])
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were cut within it; results that still read them must have been written."""
    token = _SCOPE.set((*_SCOPE.get(), uuid.uuid4().hex))
    path = "/".join([scratch_dir(spark), *_SCOPE.get()])
    try:
        yield
    finally:
        _SCOPE.reset(token)
        drop_scratch(spark, path)


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a scratch table or, without a path, all of this application's; call it when no result that reads them is
    needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path or scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_arrow(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, not only in rows, so that long texts don't gather in one batch. The setting
    stays in the session, as what it bounds runs when a result is used; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of whole rows whose texts sum to about limit bytes (one longer text stands alone), with the texts as
    UTF-8 bytes; a null text is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        if not len(sizes):
            continue
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), [x or b"" for x in texts.slice(a, b - a).to_pylist()]


class WordHash(dict):
    """64-bit hash of each word, computed once per process and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries; len(h) - n + 1 of them, none if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + mix(h[j : j + m] + np.uint64(j + 1))
    return mix(out)
