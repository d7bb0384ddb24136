"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm.common import cut, drop_scratch, scratch_scope
from ctxspark.llm.components import components
from ctxspark.llm.decontam import keep_uncontaminated
from ctxspark.llm.linededup import remove_boilerplate
from ctxspark.llm.minhash import similar_texts
from ctxspark.llm.packing import pack
from ctxspark.llm.queries import packed, table, toxicity_model
from ctxspark.llm.simhash import near_duplicates
from ctxspark.llm.toxicity import keep_clean

TOXIC_AT = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labelled documents of the input."""
    return keep_clean(docs, toxicity_model(spark, docs, sf_dir), TOXIC_AT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first occurrence; every document stays. n_chars follows the text."""
    kept = remove_boilerplate(docs)
    return kept.select(*[F.coalesce(F.length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Documents are linked by fingerprints
    within op9's radius and by a Jaccard similarity of five-word shingles of 0.8 or more. A document is an id with a
    text: repeated rows are one, but unlike texts of one id are two. Rows with a null id stay and link nothing. What goes
    grows with the input, so it is not broadcast."""
    named = docs.where("doc_id is not null").withColumn("__text", F.xxhash64("text"))
    keyed = named.select(F.struct("doc_id", "__text").alias("name"), "text")
    found = cut(near_duplicates(keyed, "name").select("id", F.col("component").alias("low")))
    links = found.unionByName(similar_texts(keyed, "name")).where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    gone = cut(components(links).where("node <> root").select(F.col("node.doc_id").alias("__id"), F.col("node.__text").alias("__of")))
    kept = named.join(gone.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__of")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item of the benchmark go."""
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in token sequences."""
    return packed(pack(docs))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("best-fit packing", packing)]

#: SQL can express neither the trained classifier nor the fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote for itself goes when the stage is over, and its input with it; what the last one
    reads stays in the scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = getattr(docs, "scratch_path", None)
        with scratch_scope(spark):
            docs = cut(stage(spark, docs, sf_dir), outside=True)
        if before:
            drop_scratch(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
