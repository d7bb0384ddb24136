"""Column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 16


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: minimum, maximum, rows, non-null rows, distinct values, and the sums of the first five powers."""
    x = F.col(column).cast("double")
    powers = [F.sum(F.pow(x, F.lit(float(k)))).alias(f"moment_{k}") for k in range(1, 6)]
    return df.agg(F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.count("*").alias("n_rows"), F.count(x).alias("non_null"), F.count_distinct(x).alias("n_distinct"), *powers)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, rows): equal-width bins between minimum and maximum, empty ones left out; the maximum is in the last."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(x.isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("bigint").alias("bin")).agg(F.count("*").alias("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, rows) of the non-null values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
