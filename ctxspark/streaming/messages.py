"""Structured Streaming over a folder of messages: stateless extraction, then batches merged into a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ctxspark.context import extract as E
from ctxspark.context.store import RAW, Contexts


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RAW).parquet(path)


def stream_atoms(raw: DataFrame) -> DataFrame:
    """The atoms of a stream of messages; no state is kept."""
    return E.exploded(E.messages(raw))


def merge_into(contexts: Contexts, raw: DataFrame, context: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to the context; a batch that comes again after a failure adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["message_id"]).join(contexts.messages(context), "message_id", "left_anti")
        if new.limit(1).count():
            contexts.load(context, new.withColumn("ordinal", F.col("ordinal")))

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
