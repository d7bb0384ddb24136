"""Reproducible dataset snapshots: splits by hash, deterministic shuffles, rank shards, batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions.hashing import bucket, hex_hash

#: Upper ends of the training and validation bands, of 100.
TRAIN, VALIDATION = 80, 90
#: Groups that an order is numbered in; each is a range of the hash, so groups are even.
RANGES = 4096


def split_of(b: Column) -> Column:
    return F.when(b < TRAIN, "train").when(b < VALIDATION, "validation").otherwise("test")


def assign_splits(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """df with split, from its key's text alone (epoch 0)."""
    return df.withColumn("split", split_of(bucket(key, seed)))


def leakage(df: DataFrame, key: str) -> DataFrame:
    """The smallest key text that stands in more than one split, if there is one."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("NULL")).alias(key)
    return df.groupBy(text).agg(F.count_distinct("split").alias("splits")).where("splits > 1").orderBy(key).limit(1)


def epoch_plan(rows: DataFrame, seed: int, epoch: int, rank: int = 0, world_size: int = 1, rowid: str = "rowid") -> DataFrame:
    """rows of one rank in an epoch's order, with ordinal (place among all ranks) and position (place in the rank).

    The order is that of the hash of (seed, epoch, rowid), then of the rowid. It is numbered range by range of the
    hash: counts per range give where each starts, so no task sorts more than a range."""
    if world_size < 1 or rank >= world_size:
        raise ValueError("rank must be less than world-size, and world-size at least 1")
    hashed = rows.withColumn("__h", hex_hash(F.col(rowid).cast("string"), seed, epoch)).withColumn("__g", F.substring("__h", 1, 3))
    counts = hashed.groupBy("__g").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__g", before.alias("__start"))  # at most RANGES rows
    own = F.row_number().over(Window.partitionBy("__g").orderBy("__h", F.col(rowid).cast("string"))) - 1
    numbered = hashed.withColumn("__own", own).join(F.broadcast(starts), "__g").withColumn("ordinal", F.col("__own") + F.col("__start"))
    mine = numbered.where(F.col("ordinal") % world_size == rank)
    return mine.withColumn("position", F.expr(f"ordinal div {world_size}")).drop("__h", "__g", "__own", "__start")


def batches_of(plan: DataFrame, batch_size: int) -> Column:
    """Number of batches, as an aggregate."""
    if batch_size < 1:
        raise ValueError("batch-size must be greater than zero")
    return F.ceil(F.count("*") / batch_size).cast("bigint")


def batch(plan: DataFrame, batch_size: int, number: int) -> DataFrame:
    if batch_size < 1:
        raise ValueError("batch-size must be greater than zero")
    return plan.where((F.col("position") >= number * batch_size) & (F.col("position") < (number + 1) * batch_size))


class BatchReader:
    """Batches of a snapshot's split for a training loop: len(), iteration, and provenance.

    Rows come from Spark partition by partition, so the driver holds about a batch. Numbers become tensors if torch is
    there (NULL as 0), other columns lists. Loader workers take every n-th batch, and read and sort its rows only."""

    def __init__(self, engine, dataset: str, batch_size: int = 256, split: str = "train", epoch: int = 0, rank: int = 0, world_size: int = 1, worker: int = 0, workers: int = 1):
        self.engine, self.dataset, self.batch_size, self.split = engine, dataset, batch_size, split
        self.epoch, self.rank, self.world_size, self.worker, self.workers = epoch, rank, world_size, worker, workers
        self.meta = engine.snapshots.meta(dataset)
        self.columns = [f["name"] for f in self.meta["features"]] + [self.meta["label"]["name"]]

    def plan(self) -> DataFrame:
        return self.engine.snapshots.plan(self.dataset, self.epoch, self.rank, self.world_size, self.split)

    def __len__(self) -> int:
        n = self.plan().agg(batches_of(self.plan(), self.batch_size)).first()[0]
        return len(range(self.worker, n, self.workers))

    def __iter__(self) -> Iterator[dict]:
        plan = self.plan().where(F.expr(f"(position div {self.batch_size}) % {self.workers}") == self.worker)
        rows = self.engine.snapshots.rows(self.dataset, plan).orderBy("position").select("position", *self.columns)
        held, number = [], 0
        for r in rows.toLocalIterator(prefetchPartitions=True):
            k = r["position"] // self.batch_size
            if k != number and held:
                yield self._batch(held)
                held = []
            number = k
            held.append(r)
        if held:
            yield self._batch(held)

    def _batch(self, rows: list) -> dict:
        out = {}
        for c in self.columns:
            values = [r[c] for r in rows]
            if all(x is None or isinstance(x, (int, float, bool)) for x in values):
                values = [0 if x is None else x for x in values]
                try:
                    import torch

                    values = torch.tensor(values)
                except ImportError:
                    pass
            out[c] = values
        return out

    def explain_batch(self, number: int) -> dict[str, str]:
        return {r.field: r.value for r in self.engine.snapshots.explain(self.dataset, self.batch_size, self.epoch, number, self.rank, self.world_size).collect()}
