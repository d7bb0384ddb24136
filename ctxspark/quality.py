"""Retrieval quality over regenerated conversations: what the context view and each baseline show of what is needed.

All conversations go through every method at once, as one DataFrame of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark import retrieval
from ctxspark.context import extract as E
from ctxspark.context import view as V
from ctxspark.functions import text as X

#: Names that conversations of one kind differ by, and the alias that they all know.
OLD, NEW, DOGS = ("Seattle", "Austin", "Boston", "Chicago", "Miami"), ("Denver", "NYC", "Portland", "Atlanta", "Phoenix"), ("Mochi", "Biscuit", "Nori", "Pixel", "Taco")
ALIASES = {"dog": "convo about dog"}
MASK = "[redacted:confidential_customer_data]"

#: Kinds of conversation as (query, tab, messages, required, stale, restricted); a message is (number, text,
#: tab), where the tab None is found by rule.
KINDS = (
    ("Find restaurants near me", "", ((1, "I live in {old}.", ""), (2, "I prefer quiet restaurants.", "food"), (24, "Actually I moved to {new}.", "")), ("{new}", "quiet restaurants"), ("{old}",), ()),
    ("recommend a restaurant", "food", ((1, "I prefer spicy restaurants.", "food"), (20, "I prefer vegan restaurants.", "food")), ("vegan restaurants",), ("spicy restaurants",), ()),
    ("what does my dog like and what is my dog name?", "dog", ((1, "My dog is named {dog}.", None), (2, "My dog likes salmon.", None)), ("{dog}", "salmon"), (), ()),
    ("what does my dog like?", "dog", ((1, "My dog likes salmon.", None), (30, "My dog likes chicken.", None)), ("chicken",), ("salmon",), ()),
    ("what restaurant preference should I remember?", "food", ((1, "I prefer dark mode.", "ui"), (2, "I prefer quiet restaurants.", "food"), (26, "I like cat cafes.", "pets")), ("quiet restaurants",), (), ()),
    ("what debug todo should I investigate?", "debugging sqlite perf", ((1, "Debug this later: sqlite perf join misses.", None),), ("sqlite perf join misses",), (), ()),
    ("what task do I need todo?", "", ((1, "I need write README benchmark section.", ""),), ("write readme benchmark section",), (), ()),
    ("what security constraint should I follow?", "", ((1, "Never share password hunter2 or api key tokens.", ""),), (MASK,), (), ("hunter2", "api key tokens")),
    ("what confidential constraint should I remember?", "", ((1, "Remember that secret launch code is ORCA-77.", ""),), (MASK,), (), ("orca-77",)),
    ("what open question or decision is active?", "project roadmap", ((1, "Decision: context is data.", "project roadmap"), (2, "Can we optimize vectorized execution?", "project roadmap")), ("context is data", "optimize vectorized execution"), (), ()),
    ("what restaurant preference should I remember?", "food", (*((k, f"I prefer durable but irrelevant note {k}.", "profile-noise") for k in range(1, 25)), (50, "I prefer quiet restaurants.", "food")), ("quiet restaurants",), (), ()),
)
#: What the rest of a conversation is about.
TOPICS = (
    "assistant summarized unrelated calendar chatter", "user asked about build output and test names", "assistant discussed travel planning without durable facts", "user switched to UI polish notes for a moment",
    "assistant compared cache warmup strategies", "user mentioned a random movie recommendation", "assistant noted benchmark methodology in passing", "user bounced to docs wording and back again",
)


def conversations(spark: SparkSession, scenarios: int, messages: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, scenarios (context, query, wanted), needles (context, kind, needle))."""
    said, asked, needed = [], [], []
    for i in range(scenarios):
        query, tab, own, *needles = KINDS[i % len(KINDS)]
        v = i // len(KINDS) % 5
        filled = lambda text, v=v: text.replace("{old}", OLD[v]).replace("{new}", NEW[v]).replace("{dog}", DOGS[v])
        name, base = f"quality_{i + 1}", (i + 1) * 10_000
        rows = [(base + k, "user", filled(text), tab or "", tab is None) for k, text, tab in own]
        for k in range(len(rows), messages):
            rows.append((base + 1001 + k, "user" if k % 2 else "assistant", f"Filler turn {base + 1001 + k}: {TOPICS[(k + i) % len(TOPICS)]}.", "", False))
        said += [(name, k, *row) for k, row in enumerate(rows)]
        asked.append((name, query, E.resolve_aliases(ALIASES).get(tab, tab)))
        needed += [(name, kind, filled(x).lower()) for kind, xs in zip(("required", "stale", "restricted"), needles) for x in xs]
    raw = spark.createDataFrame(said, "context string, ordinal bigint, message_id bigint, speaker string, text string, tab string, auto_tab boolean")
    return raw, spark.createDataFrame(asked, "context string, query string, wanted string"), spark.createDataFrame(needed, "context string, kind string, needle string")


def views(raw: DataFrame, scenarios: DataFrame, budget: int, receipts: bool = False) -> DataFrame:
    """(context, line, cost): the atoms that each conversation's view shows."""
    atoms = V.with_status(E.exploded(E.messages(raw, ALIASES))).join(scenarios, "context")
    resolved: Column = E.resolve_tab(F.col("tab"), ALIASES) == F.col("wanted")
    tagged = F.exists("tags", lambda t: E.resolve_tab(t, ALIASES) == F.col("wanted"))
    own = atoms.where((F.col("wanted") == "") | resolved | tagged).where("status = 'active'")
    shown = V.diverse(own.withColumn("utility", V.utility(F.col("query")))).withColumn("line", V.rendered(receipts))
    return V.fill_budget(V.ranked(shown.withColumn("cost", X.token_cost(F.col("line")))), budget).select("context", "line", "cost")


def quality_table(spark: SparkSession, scenarios: int = 50, messages: int = 80, budget: int = 192) -> DataFrame:
    """(method, recall, tokens, stale_excluded, restricted_excluded): shares of all needles in per cent, and the mean
    tokens that a conversation's text takes."""
    raw, asked, needed = conversations(spark, scenarios, messages)
    by_query = [(q, raw.join(asked.where(F.col("query") == q).select("context"), "context", "left_semi")) for q in dict.fromkeys(k[0] for k in KINDS)]
    methods = {
        "context view": views(raw, asked, budget),
        "full history": retrieval.full_history(raw),
        "recency window": retrieval.recency_window(raw, budget),
        "keyword scan": reduce(DataFrame.unionByName, [retrieval.keyword_scan(m, q, budget).select("context", "line", "cost") for q, m in by_query]),
        "lexical retrieval": reduce(DataFrame.unionByName, [retrieval.lexical_rag(m, q, budget).select("context", "line", "cost") for q, m in by_query]),
        "extractive summary": retrieval.extractive_summary(raw, budget),
    }
    shown = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("method"), "context", "line", F.col("cost").cast("double").alias("cost")) for name, df in methods.items()])
    tokens = shown.groupBy("method").agg((F.sum("cost") / scenarios).alias("tokens"))
    every = needed.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in methods], "method string")))  # six methods
    hit = F.contains(X.lower(F.coalesce("line", F.lit(""))), F.col("needle")).cast("int")
    found = every.join(shown, ["method", "context"], "left").groupBy("method", "context", "kind", "needle").agg(F.max(hit).alias("hit"))

    def share(kind: str, value: Column) -> Column:
        return F.round(F.avg(F.when(F.col("kind") == kind, value)) * 100, 1)

    shares = found.groupBy("method").agg(share("required", F.col("hit")).alias("recall"), share("stale", 1 - F.col("hit")).alias("stale_excluded"), share("restricted", 1 - F.col("hit")).alias("restricted_excluded"))
    return shares.join(tokens, "method", "left").select("method", "recall", F.round(F.coalesce("tokens", F.lit(0.0)), 1).alias("tokens"), "stale_excluded", "restricted_excluded")
