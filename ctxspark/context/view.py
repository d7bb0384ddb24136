"""Status, ranking and rendering of atoms; every step works on many contexts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.context import rules as R
from ctxspark.context.extract import resolve_tab
from ctxspark.functions import text as X


def with_status(atoms: DataFrame) -> DataFrame:
    """status and invalidated_by. Atoms of one context, tab and key form runs of equal values in order; all but the last
    run are invalidated, by the first atom of the next run."""
    own = Window.partitionBy("context", "tab", "key")
    order = own.orderBy("ordinal", "place")
    rows = atoms.withColumn("__new", F.when(F.col("value") != F.lag("value").over(order), 1).otherwise(0))
    rows = rows.withColumn("__run", F.sum("__new").over(order))
    by = F.min_by("source", F.struct("ordinal", "place")).over(own.orderBy("__run").rangeBetween(1, 1))
    rows = rows.withColumn("invalidated_by", by).drop("__new", "__run")
    return rows.withColumn("status", F.when(F.col("invalidated_by").isNull(), F.lit("active")).otherwise(F.lit("invalidated")))


def matches_tab(tab: str | None, aliases: dict[str, str]) -> Column:
    """tab is a resolved name, or nothing for all."""
    if not tab:
        return F.lit(True)
    return (resolve_tab(F.col("tab"), aliases) == tab) | F.exists("tags", lambda t: resolve_tab(t, aliases) == tab)


def utility(query: Column) -> Column:
    """Points of an atom (key, type, value) for a query."""
    q, v = X.lower(query), X.lower(F.col("value"))
    kind = F.col("type")

    def when(test: Column, points: int) -> Column:
        return F.when(test, points).otherwise(0)

    return (
        F.lit(10)
        + when((v != "") & F.contains(q, v), 40)
        + X.overlap(F.col("value"), query)
        + when((F.col("key") == "user_location") & X.contains_any(q, R.LOCATION_QUERY), 100)
        + when(kind == "constraint", 80)
        + when((kind == "preference") & X.contains_any(q, R.PREFERENCE_QUERY), 60)
        + when((kind == "preference") & X.contains_any(q, R.FOOD_QUERY) & X.contains_any(v, R.FOOD_VALUE), 90)
        + when(kind == "task", 50)
        + when(kind == "decision", 70)
        + when((kind == "question") & X.contains_any(q, R.QUESTION_QUERY), 70)
        + when((kind == "debug") & X.contains_any(q, R.DEBUG_QUERY), 70)
    )


def redacted(value: Column, labels: Column) -> Column:
    return F.when(F.array_contains(labels, R.CONFIDENTIAL), F.lit(R.REDACTED)).otherwise(value)


def rendered(receipts: bool) -> Column:
    shown = F.concat(F.col("type"), F.lit(" "), F.col("key"), F.lit("="), redacted(F.col("value"), F.col("access_labels")))
    if not receipts:
        return shown

    def part(name: str, value: Column, test: Column) -> Column:
        return F.when(test, F.concat(F.lit(f" {name}="), value)).otherwise("")

    return F.concat(
        shown,
        F.lit(" @"),
        F.col("source"),
        F.lit(" schema=ContextAtom.v1"),
        part("labels", F.array_join("access_labels", ","), F.size("access_labels") > 0),
        part("tags", F.array_join("tags", ","), F.size("tags") > 0),
        part("rule", F.col("rule"), F.col("rule") != ""),
        part("confidence", F.col("confidence"), F.col("confidence") != ""),
        part("span", F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string")), F.col("end") > F.col("start")),
    )


def diverse(active: DataFrame, by: tuple[str, ...] = ("context",)) -> DataFrame:
    """Of atoms with the same type, key and lower-cased value the one with the highest utility, then the newest."""
    w = Window.partitionBy(*by, "type", "key", X.lower(F.col("value"))).orderBy(F.desc("utility"), F.desc("ordinal"), F.desc("place"))
    return active.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(active: DataFrame, by: tuple[str, ...] = ("context",)) -> DataFrame:
    """rank from 1: highest utility, then newest."""
    return active.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("utility"), F.desc("ordinal"), F.desc("place"))))


def fill_budget(rows: DataFrame, budget: int, by: tuple[str, ...] = ("context",), order: str = "rank", cost: str = "cost") -> DataFrame:
    """The rows that a walk in order takes: each that still fits, skipping those that don't.

    Of the rows of one cost only the first budget / cost can ever be taken, so the rest need not be looked at; what is
    folded in one place is bounded by the budget and not by the number of rows."""
    w = Window.partitionBy(*by, cost).orderBy(order)
    fit = rows.where(F.col(cost) <= budget).withColumn("__n", F.row_number().over(w)).where(F.col("__n") * F.col(cost) <= budget)
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["c"]
        return F.when(total <= budget, F.struct(total.alias("sum"), F.array_append(acc["taken"], x["o"]).alias("taken"))).otherwise(acc)

    walk = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(cost).cast("bigint").alias("c"))))
    taken = fit.groupBy(*by).agg(F.aggregate(walk, start, step)["taken"].alias("__t")).select(*by, F.explode("__t").alias("__o"))
    on = [rows[c].eqNullSafe(taken[c]) for c in by] + [rows[order] == taken["__o"]]
    return rows.join(taken, on, "left_semi")


def plan_view(atoms: DataFrame, query: str, tab: str | None, aliases: dict[str, str], receipts: bool) -> DataFrame:
    """The active atoms of a view, in rank order: utility, text and cost of each."""
    own = atoms.where(matches_tab(tab, aliases) & (F.col("status") == "active"))
    scored = diverse(own.withColumn("utility", utility(F.lit(query))))
    shown = scored.withColumn("text", rendered(receipts))
    return ranked(shown.withColumn("cost", X.token_cost(F.col("text"))))
