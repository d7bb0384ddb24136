"""Retrieval baselines over messages (context, ordinal, speaker, text), to compare views with, and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.context.view import fill_budget
from ctxspark.functions import text as X

#: Markers of what is worth keeping, and terms that a query term also stands for.
DURABLE = ("i live in ", "moved to ", "i prefer ", "i like ", "my dog ", "remember that ", "always ", "never ", "i need ", "i want ", "todo", "we decided ", "decision: ", "final call: ")
EXPANSIONS = {"restaurant": ("food", "cafe", "quiet"), "near": ("live", "moved"), "dog": ("puppy", "pet"), "debug": ("investigate", "todo"), "decision": ("decided", "final call")}


def lines(messages: DataFrame) -> DataFrame:
    line = F.concat("speaker", F.lit(": "), "text")
    return messages.withColumn("line", line).withColumn("cost", X.token_cost(line))


def full_history(messages: DataFrame) -> DataFrame:
    return lines(messages)


def recency_window(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages back to the first that breaks the budget."""
    w = Window.partitionBy("context").orderBy(F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    return lines(messages).withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= budget)


def query_terms(query: str) -> list[str]:
    return [t for t in dict.fromkeys("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()) if len(t) >= 3 and t not in X.QUERY_STOP]


def keyword_scan(messages: DataFrame, query: str, budget: int) -> DataFrame:
    """Messages with a query term, newest first, each that still fits."""
    terms = query_terms(query)
    test = X.contains_any(X.lower(F.col("text")), terms) if terms else F.lit(False)
    hits = lines(messages).where(test).withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("ordinal"))))
    return fill_budget(hits, budget)


def _count(low: Column, term: str) -> Column:
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term))


def lexical_rag(messages: DataFrame, query: str, budget: int) -> DataFrame:
    """Score: 5 and the number of hits for each term found, terms expanded; best first, then newest, each that fits."""
    terms = query_terms(query)
    terms += [x for t in terms for x in EXPANSIONS.get(t, ()) if x not in terms]
    low = X.lower(F.col("text"))
    score = sum((F.when(F.contains(low, F.lit(t)), 5 + _count(low, t)).otherwise(0) for t in terms), F.lit(0)).cast("bigint")
    hits = lines(messages).withColumn("score", score).where("score > 0")
    return fill_budget(hits.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("score"), F.desc("ordinal")))), budget)


def extractive_summary(messages: DataFrame, budget: int) -> DataFrame:
    """Messages with a durable marker, oldest first, each that still fits."""
    hits = lines(messages).where(X.contains_any(X.lower(F.col("text")), DURABLE))
    return fill_budget(hits.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy("ordinal"))), budget)


def quality(shown: DataFrame, needed: DataFrame) -> DataFrame:
    """shown (context, line); needed (context, kind, needle) with kind required, stale or restricted. Per context: the share
    of required needles shown in a line, and of stale and restricted ones absent from all."""
    needed = needed.groupBy("context", "kind", "needle").agg(F.count("*").alias("times"))
    found = F.contains(X.lower(F.coalesce("line", F.lit(""))), X.lower(F.col("needle")))
    rows = needed.join(shown.select("context", "line"), "context", "left").groupBy("context", "kind", "needle", "times").agg(F.max(found.cast("int")).alias("hit"))

    def share(kind: str, value: Column) -> Column:
        own = F.when(F.col("kind") == kind, F.col("times"))
        return F.sum(own * value) / F.sum(own)

    return rows.groupBy("context").agg(share("required", F.col("hit")).alias("recall"), share("stale", 1 - F.col("hit")).alias("stale_excluded"), share("restricted", 1 - F.col("hit")).alias("restricted_excluded"))
