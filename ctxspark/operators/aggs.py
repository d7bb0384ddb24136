"""Aggregates that Spark lacks, each as (keys, value) per group, in a form that spills and combines before it shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = "__k"
#: Ranges that an order is counted in before any of it is sorted.
BUCKETS = 4096


def keyed(df: DataFrame, keys: list[Column], x: Column) -> DataFrame:
    """(__k0, __k1, ..., __x): what an aggregate needs of df."""
    return df.select(*[k.alias(f"{KEYS}{i}") for i, k in enumerate(keys)], x.alias("__x"))


def key_names(n: int) -> list[str]:
    return [f"{KEYS}{i}" for i in range(n)]


def same_keys(a: DataFrame, b: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """a and b joined on their keys, NULL equal to NULL; without keys, b is one row."""
    renamed = b.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(key_names(n))], *[c for c in b.columns if c not in key_names(n)])
    if not n:
        return a.join(F.broadcast(renamed), F.lit(True), how)
    on = reduce(lambda p, q: p & q, [F.col(f"__j{i}").eqNullSafe(F.col(k)) for i, k in enumerate(key_names(n))])
    return a.join(renamed, on, how).drop(*[f"__j{i}" for i in range(n)])


def outliers(rows: DataFrame, n: int) -> DataFrame:
    """LONE-WOLF: how many values lie more than three population deviations from the mean; 0 for fewer than two values or
    no deviation. Two passes, both with partial aggregation: moments, then the count against them."""
    names = key_names(n)
    value = F.col("__x").cast("double")
    moments = rows.groupBy(*names).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(value).alias("__n"))
    far = (F.abs(value - F.col("__m")) > 3 * F.col("__s")) & (F.col("__n") >= 2) & (F.col("__s") > 0)
    return same_keys(rows, moments, n).groupBy(*names).agg(F.count(F.when(far, True)).alias("value"))


def code(x: Column, kind: str) -> Column:
    """A double that never falls as x rises, finite but for infinite numbers and NaN (which sorts last)."""
    if kind == "text":  # the first six bytes; text is compared by bytes
        return F.conv(F.rpad(F.hex(F.substring(x.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    x = x.cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def ends(c: Column) -> list[Column]:
    """The least and largest finite code, as aggregates."""
    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return [F.min(finite).alias("__lo"), F.max(finite).alias("__hi")]


def bucket(c: Column) -> Column:
    """The range, of BUCKETS between __lo and __hi, that a code lies in, in the order of the codes; NULL is below all."""
    share = F.floor((c - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BUCKETS)
    inner = F.when(F.col("__hi") > F.col("__lo"), F.least(F.greatest(share, F.lit(0)), F.lit(BUCKETS - 1))).otherwise(0)
    return F.when(c.isNull(), -2).when(F.isnan(c) | (c == float("inf")), BUCKETS).when(c == -float("inf"), -1).otherwise(inner).cast("int")


def at_places(rows: DataFrame, n: int, kind: str, places: dict) -> DataFrame:
    """(keys, a column per place): the values of each group at 1-based places in order, each given as a function of the
    number of values; NULLs don't count.

    Equal values are counted before they shuffle. Counts by range of the values tell which ranges hold the places, and
    only these are sorted, each by itself, so no task sorts a group."""
    names = key_names(n)
    rows = rows.where("__x is not null")
    c = code(F.col("__x"), kind)
    counts = rows.groupBy(*names, "__x").agg(F.count("*").alias("c"))
    ranged = same_keys(counts, rows.groupBy(*names).agg(*ends(c)), n).withColumn("__b", bucket(c)).drop("__lo", "__hi")
    own = Window.partitionBy(*names) if n else Window.partitionBy(F.lit(0))
    upto = F.sum("__n").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy(*names, "__b").agg(F.sum("c").alias("__n"))  # at most BUCKETS + 2 rows a group
    sums = sums.select(*names, "__b", (upto - F.col("__n")).alias("__before"), upto.alias("__upto"), F.sum("__n").over(own).alias("total"))
    wanted = [place(F.col("total")) for place in places.values()]
    sums = sums.where(reduce(lambda p, q: p | q, [(F.col("__before") < w) & (F.col("__upto") >= w) for w in wanted]))
    also = [f"{KEYS}{n}"]
    near = same_keys(ranged.withColumnRenamed("__b", also[0]), sums.withColumnRenamed("__b", also[0]), n + 1)
    running = Window.partitionBy(*names, *also).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("__before") + F.sum("c").over(running))
    hit = lambda w: (F.col("upto") >= w) & (F.col("upto") - F.col("c") < w)
    return near.groupBy(*names).agg(*[F.max(F.when(hit(w), F.col("__x"))).alias(name) for name, w in zip(places, wanted)])


def nearest_rank(rows: DataFrame, n: int, percent: Column, kind: str) -> DataFrame:
    """percent-check: the value at place ceil(count * p / 100) in order, p cut to 0..100 and the place at least 1; NULLs
    are skipped and the type is kept."""
    p = F.least(F.greatest(percent.cast("double"), F.lit(0.0)), F.lit(100.0))
    return at_places(rows, n, kind, {"value": lambda total: F.greatest(F.lit(1), F.ceil(total * p / 100.0))})


def median(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """mid-fr: the middle value; of two middle ones their mean as a double, for text the lower one."""
    both = at_places(rows, n, kind, {"lo": lambda total: F.floor((total + 1) / 2), "hi": lambda total: F.ceil((total + 1) / 2)})
    if kind == "text":
        return both.select(*key_names(n), F.col("lo").alias("value"))
    return both.select(*key_names(n), ((F.col("lo").cast("double") + F.col("hi").cast("double")) / 2).alias("value"))


def global_rank(df: DataFrame, x: Column, kind: str, ascending: bool, order: list[Column], name: str) -> DataFrame:
    """df with the rank of each row among all, by order, whose first key is x. Rows are ranked range by range of x, after
    as many as the ranges before hold, so no task sorts them all."""
    c = code(x, kind)
    ranged = df.crossJoin(F.broadcast(df.agg(*ends(c)))).withColumn("__b", bucket(c) * (1 if ascending else -1)).drop("__lo", "__hi")
    sums = ranged.groupBy(F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))  # at most BUCKETS + 3 rows
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__c", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.rank().over(Window.partitionBy("__b").orderBy(*order)) + F.col("__before")
    return ranged.join(F.broadcast(starts), F.col("__b") == F.col("__c")).withColumn(name, rank.cast("bigint")).drop("__b", "__c", "__before")


def arg_row(df: DataFrame, x: Column, largest: bool, order: Column | None) -> DataFrame:
    """biggest-W / biggest-L: the whole row of the largest or smallest x, NULL smallest; ties to the first in order."""
    key = x.desc_nulls_last() if largest else x.asc_nulls_first()
    return df.orderBy(key, *([order] if order is not None else [])).limit(1)


def first_value(c: Column, order: Column | None) -> Column:
    """A column that is not grouped: its first non-null value."""
    return F.first(c, ignorenulls=True) if order is None else F.min_by(c, F.when(c.isNotNull(), order))
