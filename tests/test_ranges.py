"""Places in order and global ranks by ranges, against sorted lists."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import aggs

INF = float("inf")


def values(kind, r, n):
    if kind == "text":
        return [r.choice(["", "a", "customer#", "Customer#", "日", "zz"]) + r.choice(["", str(r.randrange(30))]) for _ in range(n)]
    if kind == "int":
        return [r.choice([r.randrange(-5, 5), r.randrange(-(10**15), 10**15), 2**62 + r.randrange(3)]) for _ in range(n)]
    return [r.choice([r.uniform(-1, 1), r.uniform(900, 2000), 1e300 * r.uniform(-1, 1), INF, -INF, 0.0]) for _ in range(n)]


@pytest.mark.parametrize("kind", ["int", "real", "text"])
@pytest.mark.parametrize("keys", [0, 1])
def test_places(spark, kind, keys):
    r = random.Random(kind)
    key = lambda: r.choice([None, 1, 2]) if keys else None
    rows = [(key(), x) for x in values(kind, r, 600)] + [(key(), None) for _ in range(40)]
    df = spark.createDataFrame(rows, f"k int, x {({'int': 'bigint', 'real': 'double', 'text': 'string'})[kind]}").repartition(5)
    rows_ = aggs.keyed(df, [F.col("k")][:keys], F.col("x"))
    by = defaultdict(list)
    for k, x in rows:
        if x is not None:
            by[k].append(x)
    for percent in (0, 37, 75, 100):
        want = {k: sorted(xs, key=lambda v: v.encode() if kind == "text" else v)[max(1, math.ceil(len(xs) * percent / 100)) - 1] for k, xs in by.items()}
        got = aggs.nearest_rank(rows_, keys, F.lit(percent), kind).collect()
        assert {r["__k0"] if keys else None: r.value for r in got} == want
    none = aggs.at_places(rows_.limit(0), keys, kind, {"value": lambda total: F.lit(1)}).collect()
    assert [r.value for r in none] == ([] if keys else [None])


@pytest.mark.parametrize("kind", ["int", "real", "text"])
@pytest.mark.parametrize("up", [True, False])
def test_global_rank(spark, kind, up):
    r = random.Random(kind)
    xs = [*values(kind, r, 500), None, None, None] + ([float("nan")] * 3 if kind == "real" else [])
    df = spark.createDataFrame(list(enumerate(xs)), f"i int, x {({'int': 'bigint', 'real': 'double', 'text': 'string'})[kind]}").repartition(5)
    c = F.col("x")
    order = [c.asc_nulls_first() if up else c.desc_nulls_last()]
    got = {r.i: r.rank for r in aggs.global_rank(df, c, kind, up, order, "rank").collect()}

    def place(x):
        return (0,) if x is None else (2,) if x != x else (1, x.encode() if kind == "text" else x)

    at = [place(x) for x in xs]
    assert got == {i: 1 + sum(b < a if up else b > a for b in at) for i, a in enumerate(at)}


def test_no_range_of_a_global_rank_is_everything(spark):
    df = spark.range(10_000).select((F.col("id") * 7 % 10_007).alias("x"))
    ranked = aggs.global_rank(df, F.col("x"), "int", True, [F.col("x").asc()], "rank")
    sizes = [r["count"] for r in df.crossJoin(df.agg(*aggs.ends(aggs.code(F.col("x"), "int")))).groupBy(aggs.bucket(aggs.code(F.col("x"), "int"))).count().collect()]
    assert max(sizes) < 200 and ranked.agg(F.max("rank")).first()[0] == 10_000
