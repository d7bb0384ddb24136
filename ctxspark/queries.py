"""The registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark import retrieval
from ctxspark.context import extract as E
from ctxspark.context import rules as R
from ctxspark.context import store
from ctxspark.context import view as V
from ctxspark.functions import text as X
from ctxspark.functions.hashing import bucket
from ctxspark.lang.parser import parse
from ctxspark.operators import snapshot as S
from ctxspark.operators import stats
from ctxspark.plans.lower import Lowering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, since sums depend on the order of addition."""
    return df.select(*[F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SELECT of the dialect over the Parquet tables of a folder."""
    (statement,) = parse(text)
    return rounded(Lowering(lambda name: table(spark, sf_dir, name)).select(statement))


#: name: the dialect's text and the SQL of the same rows.
TEXTS = {
    "flagship": (
        "slay n.n_name, headcount(*) lowkey n_orders, stack(o.o_totalprice) lowkey revenue no-cap orders lowkey o link-up customer lowkey c fr-fr o.o_custkey = c.c_custkey link-up nation lowkey n fr-fr c.c_nationkey = n.n_nationkey only-if o.o_totalprice > 1000 vibe-check n.n_name hits-different revenue down-bad cap-at 10",
        "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 4) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY n_name ORDER BY sum(o_totalprice) DESC LIMIT 10",
    ),
    "scan_project": ("slay c_custkey, c_name lowkey customer, c_acctbal no-cap customer", "SELECT c_custkey, c_name AS customer, round(c_acctbal, 4) AS c_acctbal FROM customer"),
    "filter_cmp": ("slay o_orderkey, o_totalprice no-cap orders only-if o_totalprice >= 200000", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_totalprice >= 200000"),
    "filter_and_or": ("slay p_partkey, p_size no-cap part only-if p_size > 40 or-nah p_size < 5 plus p_retailprice > 1200", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 40 OR (p_size < 5 AND p_retailprice > 1200)"),
    "filter_not_null2v": (
        "slay c.c_custkey no-cap customer lowkey c left-link-up orders lowkey o fr-fr c.c_custkey = o.o_custkey plus o.o_totalprice > 300000 only-if no-cap-not o.o_orderkey > 0",
        "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE NOT coalesce(o_orderkey > 0, false)",
    ),
    "filter_truthy": ("slay n_nationkey, n_name no-cap nation only-if n_regionkey plus n_name", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 0 AND length(n_name) > 0"),
    "filter_null_literal": ("slay n_nationkey no-cap nation only-if no-cap-not (n_regionkey = ghosted) plus n_nationkey > 9", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey > 9"),
    "filter_mixed_kinds": ("slay n_nationkey no-cap nation only-if n_regionkey < n_name plus n_name != 3 plus n_nationkey < 9", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey < 9"),
    "point_lookup": ("slay c_name, c_acctbal no-cap customer only-if c_custkey = 77", "SELECT c_name, round(c_acctbal, 4) AS c_acctbal FROM customer WHERE c_custkey = 77"),
    "arith_mix": ("slay l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax lowkey v no-cap lineitem only-if l_quantity > 45", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS v FROM lineitem WHERE l_quantity > 45"),
    "int_div_trunc": ("slay p_partkey, p_size / 7 lowkey q, -p_size / 7 lowkey r no-cap part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, CAST(trunc(-p_size / 7.0) AS BIGINT) AS r FROM part"),
    "div_zero_null": ("slay n_nationkey, n_nationkey / n_regionkey lowkey q, n_nationkey / 0.0 lowkey z no-cap nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(CASE WHEN n_regionkey <> 0 THEN n_nationkey // n_regionkey END AS BIGINT) AS q, CAST(NULL AS DOUBLE) AS z FROM nation"),
    "unary_minus": ("slay c_custkey, -c_acctbal lowkey neg, -(-c_nationkey) lowkey same no-cap customer", "SELECT c_custkey, round(-c_acctbal, 4) AS neg, CAST(c_nationkey AS BIGINT) AS same FROM customer"),
    "concat_text": ("slay n_name || ':' || n_regionkey || ghosted lowkey t no-cap nation", "SELECT n_name || ':' || CAST(n_regionkey AS VARCHAR) || 'NULL' AS t FROM nation"),
    "concat_real": ("slay s_suppkey, 'q=' || (s_suppkey / 4.0) lowkey t no-cap supplier", "SELECT s_suppkey, 'q=' || regexp_replace(CAST(s_suppkey / 4.0 AS VARCHAR), '\\.?0+$', '') AS t FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'q=' || CAST(s_suppkey // 4 AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0"),
    "const_fold": ("slay r_name, 2 * 3 + 4 lowkey ten no-cap region only-if 1 + 1 = 2 cap-at 2 + 3", "SELECT r_name, CAST(10 AS BIGINT) AS ten FROM region"),
    "order_multi": ("slay n_regionkey, n_name no-cap nation hits-different n_regionkey down-bad, n_name", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name"),
    "order_alias": ("slay o_orderkey, o_totalprice * 2 lowkey twice no-cap orders hits-different twice down-bad, o_orderkey", "SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders ORDER BY o_totalprice DESC, o_orderkey"),
    "top_k": ("slay o_orderkey, o_totalprice no-cap orders hits-different o_totalprice down-bad, o_orderkey cap-at 25", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "limit_offset": ("slay c_custkey no-cap customer hits-different c_custkey cap-at 10 skip 30", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30"),
    "distinct_rows": ("slay unique-fr l_returnflag, l_linestatus no-cap lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "inner_join": ("slay o.o_orderkey, c.c_name no-cap orders lowkey o link-up customer lowkey c fr-fr o.o_custkey = c.c_custkey only-if c.c_mktsegment = 'BUILDING'", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "left_join": ("slay c.c_custkey, o.o_orderkey no-cap customer lowkey c left-link-up orders lowkey o fr-fr c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "left_join_nullcount": ("slay headcount(*) lowkey n, headcount(o.o_orderkey) lowkey k no-cap customer lowkey c left-link-up orders lowkey o fr-fr c.c_custkey = o.o_custkey", "SELECT count(*) AS n, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "theta_join": ("slay a.n_name lowkey a, b.r_name lowkey b no-cap nation lowkey a link-up region lowkey b fr-fr a.n_regionkey < b.r_regionkey", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "left_theta_join": ("slay a.r_name lowkey a, b.r_name lowkey b no-cap region lowkey a left-link-up region lowkey b fr-fr a.r_regionkey > b.r_regionkey + 2", "SELECT a.r_name AS a, b.r_name AS b FROM region a LEFT JOIN region b ON a.r_regionkey > b.r_regionkey + 2"),
    "self_join": ("slay a.n_name lowkey a, b.n_name lowkey b no-cap nation lowkey a link-up nation lowkey b fr-fr a.n_regionkey = b.n_regionkey only-if a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "star_join3": (
        "slay p.p_brand, headcount(*) lowkey n, stack(l.l_quantity) lowkey q no-cap lineitem lowkey l link-up part lowkey p fr-fr l.l_partkey = p.p_partkey link-up supplier lowkey s fr-fr l.l_suppkey = s.s_suppkey vibe-check p.p_brand",
        "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY p_brand",
    ),
    "join_miss_zero": ("slay headcount(*) lowkey n, stack(o.o_totalprice) lowkey s no-cap orders lowkey o link-up region lowkey r fr-fr o.o_custkey + 1000000000 = r.r_regionkey", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders JOIN region ON o_custkey + 1000000000 = r_regionkey"),
    "count_star": ("slay headcount(*) lowkey n no-cap lineitem", "SELECT count(*) AS n FROM lineitem"),
    "count_col": ("slay headcount(l_quantity) lowkey n no-cap lineitem only-if l_discount > 0.05", "SELECT count(l_quantity) AS n FROM lineitem WHERE l_discount > 0.05"),
    "count_distinct": ("slay l_returnflag, headcount(unique-fr l_suppkey) lowkey n no-cap lineitem vibe-check l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "sum_int": ("slay stack(p_size) lowkey s no-cap part", "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part"),
    "sum_real": ("slay stack(l_extendedprice) lowkey s no-cap lineitem", "SELECT round(sum(l_extendedprice), 4) AS s FROM lineitem"),
    "avg": ("slay l_linestatus, mid(l_quantity) lowkey m no-cap lineitem vibe-check l_linestatus", "SELECT l_linestatus, round(avg(l_quantity), 4) AS m FROM lineitem GROUP BY l_linestatus"),
    "min_max_text": ("slay L(c_name) lowkey lo, goat(c_name) lowkey hi, L(c_acctbal) lowkey a, goat(c_custkey) lowkey b no-cap customer", "SELECT min(c_name) AS lo, max(c_name) AS hi, round(min(c_acctbal), 4) AS a, max(c_custkey) AS b FROM customer"),
    "group_multi": ("slay l_returnflag, l_linestatus, headcount(*) lowkey n, stack(l_tax) lowkey t no-cap lineitem vibe-check l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY 1, 2"),
    "group_expr": ("slay p_size / 10 lowkey b, headcount(*) lowkey n no-cap part vibe-check p_size / 10", "SELECT CAST(p_size // 10 AS BIGINT) AS b, count(*) AS n FROM part GROUP BY 1"),
    "having": ("slay o_custkey, headcount(*) lowkey n no-cap orders vibe-check o_custkey bussin-only headcount(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "having_ignored": ("slay r_name no-cap region bussin-only r_regionkey > 99", "SELECT r_name FROM region"),
    "agg_expr": ("slay o_orderpriority, stack(o_totalprice) / headcount(*) + 1 lowkey m no-cap orders vibe-check o_orderpriority", "SELECT o_orderpriority, round(sum(o_totalprice) / count(*) + 1, 4) AS m FROM orders GROUP BY 1"),
    "global_empty_agg": ("slay headcount(*) lowkey n, stack(p_size) lowkey s, goat(p_name) lowkey g no-cap part only-if p_size > 9999", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, max(p_name) AS g FROM part WHERE p_size > 9999"),
    "group_nongrouped_first": ("slay n_regionkey, n_regionkey * 2 lowkey d, headcount(*) lowkey n no-cap nation vibe-check n_regionkey * 2", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_regionkey * 2 AS BIGINT) AS d, count(*) AS n FROM nation GROUP BY 1, 2"),
    "lone_wolf_global": ("slay LONE-WOLF(value) lowkey n no-cap events", "WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events) SELECT count(*) AS n FROM events, m WHERE abs(value - a) > 3 * s AND s > 0"),
    "lone_wolf_group": ("slay event_type, lone-wolf(value) lowkey n no-cap events vibe-check event_type", "WITH m AS (SELECT event_type, avg(value) AS a, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT e.event_type, CAST(sum(CASE WHEN abs(value - a) > 3 * s AND s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1"),
    "median_even_odd": ("slay mid-fr(o_totalprice) lowkey m, mid-fr(o_custkey) lowkey k no-cap orders", "SELECT round(median(o_totalprice), 4) AS m, round(median(o_custkey), 4) AS k FROM orders"),
    "median_group": ("slay l_returnflag, mid-fr(l_extendedprice) lowkey m no-cap lineitem vibe-check l_returnflag", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1"),
    "median_text": ("slay n_regionkey, mid-fr(n_name) lowkey m no-cap nation vibe-check n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, list_sort(list(n_name))[(count(*) + 1) // 2] AS m FROM nation GROUP BY 1"),
    "percentile_p75": ("slay percent-check(l_extendedprice, 75) lowkey p no-cap lineitem", "SELECT round(list_sort(list(l_extendedprice))[greatest(1, CAST(ceil(count(*) * 75 / 100.0) AS BIGINT))], 4) AS p FROM lineitem"),
    "percentile_p0_p100": ("slay percent-check(p_size, 0) lowkey lo, percent-check(p_size, 250) lowkey hi no-cap part", "SELECT CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part"),
    "percentile_group": ("slay o_orderpriority, percent-check(o_totalprice, 90) lowkey p no-cap orders vibe-check o_orderpriority", "SELECT o_orderpriority, round(list_sort(list(o_totalprice))[CAST(ceil(count(*) * 90 / 100.0) AS BIGINT)], 4) AS p FROM orders GROUP BY 1"),
    "argmax_row": ("slay biggest-W(p_partkey) no-cap part", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 4) AS p_retailprice FROM part ORDER BY p_partkey DESC LIMIT 1"),
    "argmin_row": ("slay biggest-L(s_suppkey) no-cap supplier", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 4) AS s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1"),
    "rank_global": ("slay c_custkey, era hits-different c_acctbal down-bad lowkey r no-cap customer", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS r FROM customer"),
    "rank_partition": ("slay c_custkey, era split-by c_nationkey hits-different c_acctbal lowkey r no-cap customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r FROM customer"),
    "rank_desc_ties": ("slay l_orderkey, l_linenumber, era split-by l_suppkey hits-different l_quantity down-bad lowkey r no-cap lineitem", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem"),
    "rank_after_filter": ("slay o_orderkey, era split-by o_orderstatus hits-different o_totalprice lowkey r no-cap orders only-if o_totalprice > 100000 hits-different o_orderkey", "SELECT o_orderkey, r FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r FROM orders WHERE o_totalprice > 100000) ORDER BY o_orderkey"),
}

for _name, (_text, _sql) in TEXTS.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: run(spark, sf_dir, text)
    ORACLES[_name] = _sql


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT n_name, r_name FROM nation, region")
def cross_join(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_name")))


@query("SELECT min(value) AS min_value, max(value) AS max_value, count(*) AS n_rows, count(value) AS non_null, count(DISTINCT value) AS n_distinct, round(sum(value), 2) AS moment_1, round(sum(value * value), 2) AS moment_2 FROM events")
def column_stats(spark, sf_dir):
    s = stats.column_stats(table(spark, sf_dir, "events"), "value")
    return s.select("min_value", "max_value", "n_rows", "non_null", "n_distinct", F.round("moment_1", 2).alias("moment_1"), F.round("moment_2", 2).alias("moment_2"))


@query("WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT CAST(least(floor((p_size - lo) / ((hi - lo) / 16.0)), 15) AS BIGINT) AS bin, count(*) AS n_rows FROM part, e GROUP BY 1")
def histogram16(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "part"), "p_size")


@query("SELECT o_orderpriority AS value, count(*) AS n_rows FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


# snapshots

_HASH = """k AS (SELECT DISTINCT {key} AS key, CAST({key} AS VARCHAR) AS s FROM {table}),
f AS (SELECT key, list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(1, length(s)+1), lambda i: ascii(substr(s, i::BIGINT, 1))::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM k),
a AS (SELECT key, xor({seed}::UHUGEINT, h) AS v FROM f), a1 AS (SELECT key, xor(v, v >> 33) AS v FROM a),
b AS (SELECT key, ((((v >> 32) * 18397679294719823053::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT + (v & 4294967295::UHUGEINT) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM a1),
c AS (SELECT key, xor(v, v >> 33) AS v FROM b),
d AS (SELECT key, ((((v >> 32) * 14181476777654086739::UHUGEINT) % 4294967296::UHUGEINT) * 4294967296::UHUGEINT + (v & 4294967295::UHUGEINT) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS v FROM c),
z AS (SELECT key, xor(v, v >> 33) AS v FROM d)"""
_SPLIT = "CASE WHEN v % 100 < 80 THEN 'train' WHEN v % 100 < 90 THEN 'validation' ELSE 'test' END"
SEED = 42
_EVENTS = _HASH.format(key="user_id", table="events", seed=SEED)
_ROWS = _HASH.format(key="event_id", table="events", seed=SEED)


@query(f"WITH {_EVENTS} SELECT event_id, user_id, {_SPLIT} AS split, CAST(v % 100 AS BIGINT) AS bucket FROM events JOIN z ON user_id = key")
def split_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    users = e.select("user_id").distinct().withColumn("bucket", bucket(F.col("user_id").cast("string"), SEED))
    return e.join(users, "user_id").select("event_id", "user_id", S.split_of(F.col("bucket")).alias("split"), "bucket")


@query(f"WITH {_EVENTS} SELECT {_SPLIT} AS split, count(*) AS n FROM events JOIN z ON user_id = key GROUP BY 1")
def split_counts(spark, sf_dir):
    return split_by_user(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS}, s AS (SELECT CAST(user_id AS VARCHAR) AS user_id, {_SPLIT} AS split FROM events JOIN z ON event_id = key) SELECT user_id, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1 ORDER BY 1 LIMIT 1")
def leakage_check(spark, sf_dir):
    rows = S.assign_splits(table(spark, sf_dir, "events").select("event_id", "user_id"), F.col("event_id").cast("string"), SEED)
    return S.leakage(rows, "user_id")


def _train(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("rowid"), "event_type")
    return S.assign_splits(e, F.col("rowid"), SEED).where("split = 'train'")


_PLAN = f"""WITH {_ROWS},
t AS (SELECT key FROM z WHERE v % 100 < 80), o AS (SELECT t.key, row_number() OVER (ORDER BY z.v, CAST(t.key AS VARCHAR)) - 1 AS ordinal FROM t JOIN z ON t.key = z.key)"""


@query(f"{_PLAN} SELECT CAST(key AS VARCHAR) AS rowid, ordinal FROM o")
def epoch_plan(spark, sf_dir):
    return S.epoch_plan(_train(spark, sf_dir), SEED, 0).select("rowid", "ordinal")


@query(f"{_PLAN} SELECT CAST(key AS VARCHAR) AS rowid, ordinal // 3 AS position FROM o WHERE ordinal % 3 = 1")
def rank_shard(spark, sf_dir):
    return S.epoch_plan(_train(spark, sf_dir), SEED, 0, 1, 3).select("rowid", "position")


@query(f"{_PLAN} SELECT event_type AS label, count(*) AS n FROM o JOIN events ON event_id = key WHERE ordinal % 2 = 0 AND ordinal // 2 >= 64 AND ordinal // 2 < 128 GROUP BY 1")
def explain_batch_labels(spark, sf_dir):
    plan = S.epoch_plan(_train(spark, sf_dir), SEED, 0, 0, 2)
    return S.batch(plan, 64, 1).groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"))


@query(f"{_PLAN} SELECT count(*) AS samples, CAST(ceil(count(*) / 256.0) AS BIGINT) AS batches FROM o WHERE ordinal % 2 = 1")
def export_counts(spark, sf_dir):
    plan = S.epoch_plan(_train(spark, sf_dir), SEED, 0, 1, 2)
    return plan.agg(F.count("*").alias("samples"), S.batches_of(plan, 256).alias("batches"))


# conversation memory, over messages derived from structured rows


def query_of_messages(sql: str):
    """Registers f(messages), over every message."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spoken(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


_SAID = """CASE c_custkey % 8 WHEN 0 THEN 'I live in ' || n_name || '.' WHEN 1 THEN 'Actually I moved to ' || n_name || '!' WHEN 2 THEN 'I like cafes in ' || n_name
 WHEN 3 THEN 'Never share the password of ' || c_name WHEN 4 THEN 'We decided to ship ' || c_mktsegment || ' parts. Done.' WHEN 5 THEN 'Should ' || c_name || ' join the dog project?'
 WHEN 6 THEN 'TODO: fix the ' || n_name || ' benchmark; soon' ELSE 'Nothing to note about ' || c_name END"""
_MESSAGES = f"m AS (SELECT 'ctx' || CAST(c_custkey % 5 AS VARCHAR) AS context, c_custkey AS message_id, c_custkey AS ordinal, {_SAID} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def spoken(spark, sf_dir) -> DataFrame:
    """Raw messages (context, ordinal, message_id, speaker, text, tab, auto_tab)."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    context = F.concat(F.lit("ctx"), (F.col("c_custkey") % 5).cast("string"))
    return c.select(context.alias("context"), F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("message_id"), F.lit("user").alias("speaker"), F.expr(_SAID.replace("\n", " ")).alias("text"), F.lit("").alias("tab"), F.lit(False).alias("auto_tab"))


#: Fixed values, written out for the SQL apart from those that the engine uses.
_HIDDEN = "regexp_matches(lower(text), 'password|secret|api key|api token|access token|auth token|bearer token|refresh token|session token|credential token|ssn|social security|credit card|confidential|private key')"
_LABELS = f"""list_filter(['AGENT_INTERNAL', CASE WHEN {_HIDDEN} THEN 'CONFIDENTIAL_CUSTOMER_DATA' END, CASE WHEN regexp_matches(lower(text), 'tool call|tool trace|stack trace') THEN 'TOOL_TRACE' END], lambda x: x IS NOT NULL)"""
_MASK = "'[redacted:CONFIDENTIAL_CUSTOMER_DATA]'"


def _says(parts: str, words: str = "") -> str:
    """Whether the text holds one of the parts, or one of the words as a whole word."""
    tests = [f"regexp_matches(lower(text), '{parts}')"] if parts else []
    tests += [f"regexp_matches(lower(text), '(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)')"] if words else []
    return "(" + " OR ".join(tests) + ")"


def _listed(*items: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{value}' END" for value, test in items) + "], lambda x: x IS NOT NULL)"


_ENTITIES = _listed(
    ("dog", _says("", "dog|puppy|pet")),
    ("sqlite", _says("sqlite|sql|b-tree|btree")),
    ("performance", _says("benchmark|perf|slow|latency")),
    ("storage-safety", _says("wal|lock|recovery|transaction")),
    ("docs", _says("readme|docs|documentation")),
    ("ml-dataset", _says("pytorch|torch|dataset|training")),
)
_TAGGED = _listed(
    ("debug this later:95:matched follow-up marker", _says("debug this later|investigate|look into")),
    ("open questions:92:contains question mark", _says("[?]")),
    ("convo about dog:90:matched pet/dog term", _says("", "dog|puppy|pet")),
    ("current tasks:89:matched task marker", _says("i need |i want |todo")),
    ("constraints:88:matched constraint marker", _says("remember that|always |never |don''t |do not ")),
    ("preferences:86:matched preference marker", _says("i like |i prefer ")),
    ("debugging sqlite perf:85:matched sql/sqlite/join term", _says("sqlite|b-tree|btree", "sql|join")),
    ("benchmarks:82:matched benchmark metric term", _says("benchmark|recall|avg tokens|average tokens")),
    ("memory baselines:80:matched memory baseline term", _says("mem0|rag|recency-window")),
    ("agent integration:78:matched agent/context term", _says("agent|context pack|current_context|dogfood|helper")),
    ("project roadmap:76:matched project planning term", _says("roadmap|next step|project")),
    ("docs:74:matched docs/readme term", _says("readme|docs|documentation")),
)


def _any(column: str, parts) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(column, p.replace("'", "''")) for p in parts) + ")"


@query(f"WITH {_MESSAGES} SELECT context, message_id, array_to_string({_LABELS}, ',') AS labels FROM m")
def access_labels(spark, sf_dir):
    return spoken(spark, sf_dir).select("context", "message_id", F.array_join(E.access_labels(F.col("text")), ",").alias("labels"))


@query(f"WITH {_MESSAGES} SELECT message_id, array_to_string({_ENTITIES}, ',') AS entities FROM m")
def entities(spark, sf_dir):
    return spoken(spark, sf_dir).select("message_id", F.array_join(E.entities(F.col("text")), ",").alias("entities"))


@query(f"WITH {_MESSAGES}, t AS (SELECT message_id, {_TAGGED} AS l FROM m) SELECT message_id, CASE WHEN len(l) = 0 THEN 'main:1:fallback' ELSE array_to_string(l, ' | ') END AS tags FROM t")
def tag_suggestions(spark, sf_dir):
    return spoken(spark, sf_dir).select("message_id", F.array_join(E.reasons(E.tag_suggestions(F.col("text"))), " | ").alias("tags"))


#: What the rules find in each of the eight kinds of message; the last one says nothing.
_ATOMS = """u AS (SELECT *, CASE WHEN kind < 2 THEN 'user_location' WHEN kind = 2 THEN 'user_preference' WHEN kind = 3 THEN 'user_constraint.security'
  ELSE CASE kind WHEN 4 THEN 'decision.' WHEN 5 THEN 'open_question.' ELSE 'debug_followup.' END || array_to_string(list_filter(regexp_extract_all(lower(value), '[a-z0-9]+'),
    lambda t: len(t) >= 3 AND t NOT IN ('and', 'are', 'for', 'from', 'inside', 'should', 'that', 'the', 'this', 'use', 'using', 'with', 'also', 'says', 'measured'))[1:4], '_') END AS key,
  CASE WHEN kind < 2 THEN 'fact' ELSE ['preference', 'constraint', 'decision', 'question', 'debug'][kind - 1] END AS type,
  [10, 20, 7, 6, 11, 0, 6][kind + 1] AS start, strlen(text) - [1, 1, 0, 0, 7, 0, 6][kind + 1] AS stop
  FROM (SELECT *, CASE kind WHEN 0 THEN substr(text, 11, length(text) - 11) WHEN 1 THEN substr(text, 21, length(text) - 21) WHEN 2 THEN substr(text, 8) WHEN 3 THEN 'never' || substr(text, 6)
    WHEN 4 THEN substr(text, 12, length(text) - 18) WHEN 5 THEN substr(text, 1, length(text) - 1) ELSE substr(text, 7, length(text) - 12) END AS value FROM (SELECT *, message_id % 8 AS kind FROM m) WHERE kind < 7))"""


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS} SELECT message_id, key, value FROM u")
def extract_atoms(rows):
    return rows.select("message_id", F.explode(E.atoms(F.col("text"))).alias("a")).select("message_id", "a.key", "a.value")


@query(
    f"""WITH {_MESSAGES}, {_ATOMS} SELECT message_id, CAST(0 AS INT) AS place, key, value, type,
 ['marker:i live in ', 'marker:i moved to ', 'marker:i like ', 'marker:never ', 'marker:we decided ', 'punctuation:question_mark', 'marker:todo: '][kind + 1] AS rule,
 CASE kind WHEN 5 THEN '0.75' ELSE '0.92' END AS confidence, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", CASE kind WHEN 5 THEN text ELSE value END AS snippet FROM u"""
)
def extract_all_atoms(spark, sf_dir):
    """Every rule, with spans and rule labels; a test holds it against a plain model, too."""
    return spoken(spark, sf_dir).select("message_id", F.posexplode(E.atoms(F.col("text"))).alias("place", "a")).select("message_id", "place", "a.*")


def _atoms(rows) -> DataFrame:
    return V.with_status(E.exploded(E.messages(rows)))


_STATUS = "r AS (SELECT *, coalesce(value <> lag(value) OVER (PARTITION BY context, key ORDER BY ordinal), false)::INT AS new FROM u), q AS (SELECT *, sum(new) OVER (PARTITION BY context, key ORDER BY ordinal) AS run FROM r), st AS (SELECT *, CASE WHEN run = max(run) OVER (PARTITION BY context, key) THEN 'active' ELSE 'invalidated' END AS status FROM q)"
_BY = "LEFT JOIN (SELECT context, key, run - 1 AS run, min(ordinal) AS first FROM q GROUP BY 1, 2, 3) n USING (context, key, run)"


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS}, {_STATUS} SELECT st.message_id, st.key, status, 'message_' || CAST(first AS VARCHAR) AS invalidated_by FROM st {_BY}")
def invalidate_window(rows):
    return _atoms(rows).select(F.col("ordinal").alias("message_id"), "key", "status", "invalidated_by")


_ALIASES = {"puppy": "dog", "dog": "pets", "a": "b", "b": "a"}


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'pets' WHEN 1 THEN 'pets' WHEN 2 THEN 'a' WHEN 3 THEN 'main' ELSE n_name END AS tab FROM nation")
def tab_alias_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.expr("CASE n_nationkey % 5 WHEN 0 THEN ' puppy. ' WHEN 1 THEN 'dog because x' WHEN 2 THEN 'a' WHEN 3 THEN '!?' ELSE n_name END")
    return n.select("n_nationkey", E.resolve_tab(name, _ALIASES).alias("tab"))


QUERY_TEXT = "recommend a quiet restaurant near me in france"
_UTILITY = f"""CASE WHEN contains('{QUERY_TEXT}', lower(value)) THEN 40 ELSE 0 END + 10
 + least(80, 20 * len(list_filter(['recommend', 'quiet', 'restaurant', 'france'], lambda t: contains(lower(value), t))))
 + CASE WHEN key = 'user_location' THEN 100 ELSE 0 END + CASE type WHEN 'constraint' THEN 80 WHEN 'decision' THEN 70 ELSE 0 END
 + CASE WHEN key = 'user_preference' THEN 60 ELSE 0 END + CASE WHEN key = 'user_preference' AND regexp_matches(lower(value), 'restaurant|cafe|food|quiet|coffee') THEN 90 ELSE 0 END"""


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS}, {_STATUS} SELECT message_id, CAST({_UTILITY} AS INT) AS utility FROM st WHERE status = 'active'")
def utility_rank(rows):
    active = _atoms(rows).where("status = 'active'")
    return active.select(F.col("ordinal").alias("message_id"), V.utility(F.lit(QUERY_TEXT)).alias("utility"))


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS} SELECT max(message_id) AS message_id, key, lower(value) AS value FROM u GROUP BY 2, 3")
def diversity_dedupe(rows):
    atoms = _atoms(rows).withColumn("utility", F.lit(1))
    return V.diverse(atoms, ()).select(F.col("ordinal").alias("message_id"), "key", X.lower(F.col("value")).alias("value"))


@query(
    f"""WITH RECURSIVE {_MESSAGES}, i AS (SELECT context, message_id, CAST(greatest(1, (strlen(text) + 3) // 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY context ORDER BY message_id DESC) AS rank FROM m),
w AS (SELECT context, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS taken FROM (SELECT DISTINCT context FROM m)
 UNION ALL SELECT w.context, i.rank, CASE WHEN spent + cost <= 200 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 200 THEN message_id END FROM w JOIN i ON w.context = i.context AND i.rank = w.rank + 1)
SELECT context, taken AS message_id FROM w WHERE taken IS NOT NULL"""
)
def budget_fill(spark, sf_dir):
    rows = spoken(spark, sf_dir).withColumn("cost", X.token_cost(F.col("text"))).withColumn("utility", F.lit(0)).withColumn("place", F.lit(0))
    return V.fill_budget(V.ranked(rows), 200).select("context", "message_id")


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS} SELECT message_id, type || ' ' || key || '=' || CASE WHEN {_HIDDEN} THEN {_MASK} ELSE value END AS line FROM u")
def redact_render(rows):
    return _atoms(rows).select(F.col("ordinal").alias("message_id"), V.rendered(False).alias("line"))


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS} SELECT 'main' AS tab, CAST((SELECT count(*) FROM m) AS VARCHAR) AS messages, CAST(count(*) AS VARCHAR) AS atoms, CAST((SELECT max(message_id) FROM m) AS VARCHAR) AS last_message FROM u")
def show_tabs(rows):
    messages = E.messages(rows)
    return store.tabs(messages, V.with_status(E.exploded(messages)), {}).select("tab", "messages", "atoms", "last_message")


@query_of_messages(f"""WITH {_MESSAGES}, {_ATOMS} SELECT 'ConversationMessage' AS schema, 'message_' || CAST(message_id AS VARCHAR) AS source_id, CASE WHEN {_HIDDEN} THEN {_MASK} ELSE text END AS value, '0:' || CAST(strlen(text) AS VARCHAR) AS source_span FROM m
UNION ALL SELECT 'ContextAtom', 'message_' || CAST(message_id AS VARCHAR), type || ' ' || key || '=' || CASE WHEN {_HIDDEN} THEN {_MASK} ELSE value END, CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR) FROM u""")
def show_objects(rows):
    messages = E.messages(rows)
    found = store.objects(messages, V.with_status(E.exploded(messages)), {})
    return found.select("schema", F.when(F.col("source") == "", F.col("object_id")).otherwise(F.col("source")).alias("source_id"), "value", "source_span")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in R.SCHEMAS)
    + f") AS t({', '.join(R.SCHEMA_COLUMNS).replace('schema,', '"schema",')})"
)
def schema_registry(spark, sf_dir):
    return store.schema_registry(spark)


@query_of_messages(f"WITH {_MESSAGES}, {_ATOMS}, {_STATUS} SELECT context, count(*) AS scanned, count(*) FILTER (status = 'invalidated') AS invalidated, count(*) FILTER (status = 'active') AS active FROM st GROUP BY 1")
def explain_counts(rows):
    a = _atoms(rows)
    return a.groupBy("context").agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "invalidated").alias("invalidated"), F.count_if(F.col("status") == "active").alias("active"))


# retrieval baselines

_LINES = f"{_MESSAGES}, l AS (SELECT *, greatest(1, (strlen('user: ' || text) + 3) // 4) AS cost FROM m)"


@query(f"WITH {_LINES}, s AS (SELECT context, message_id, sum(cost) OVER (PARTITION BY context ORDER BY message_id DESC) AS spent FROM l) SELECT context, message_id, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 300")
def recency_window(spark, sf_dir):
    return retrieval.recency_window(spoken(spark, sf_dir), 300).select("context", "message_id", "spent")


def _walk(order: str, test: str, budget: int) -> str:
    return f"""WITH RECURSIVE {_LINES}, i AS (SELECT context, message_id, CAST(cost AS BIGINT) AS cost, row_number() OVER (PARTITION BY context ORDER BY {order}) AS rank FROM l WHERE {test}),
w AS (SELECT context, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS taken FROM (SELECT DISTINCT context FROM i)
 UNION ALL SELECT w.context, i.rank, CASE WHEN spent + cost <= {budget} THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= {budget} THEN message_id END FROM w JOIN i ON w.context = i.context AND i.rank = w.rank + 1)
SELECT context, taken AS message_id FROM w WHERE taken IS NOT NULL"""


@query(_walk("message_id DESC", _any("text", ["benchmark", "password"]), 150))
def keyword_scan(spark, sf_dir):
    return retrieval.keyword_scan(spoken(spark, sf_dir), "find the benchmark password", 150).select("context", "message_id")


_HITS = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 5 + (length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)} ELSE 0 END" for t in ("dog", "project", "puppy", "pet"))


@query(_walk(f"({_HITS}) DESC, message_id DESC", f"({_HITS}) > 0", 150))
def lexical_rag(spark, sf_dir):
    return retrieval.lexical_rag(spoken(spark, sf_dir), "the dog project", 150).select("context", "message_id")


@query(_walk("message_id", _any("text", retrieval.DURABLE), 200))
def extractive_summary(spark, sf_dir):
    return retrieval.extractive_summary(spoken(spark, sf_dir), 200).select("context", "message_id")


@query(f"WITH {_LINES} SELECT context, message_id, CAST(cost AS BIGINT) AS cost FROM l")
def full_history(spark, sf_dir):
    return retrieval.full_history(spoken(spark, sf_dir)).select("context", "message_id", "cost")


@query(f"WITH {_MESSAGES}, c AS (SELECT context, bool_or(contains(lower(text), 'france')) AS hit, bool_or(contains(lower(text), 'no such words')) AS stale FROM m GROUP BY 1) SELECT context, CAST(hit AS INT) * 1.0::DOUBLE AS recall, (1 - CAST(stale AS INT)) * 1.0::DOUBLE AS stale_excluded FROM c")
def quality_metrics(spark, sf_dir):
    shown = retrieval.full_history(spoken(spark, sf_dir))
    contexts = shown.select("context").distinct()
    needed = contexts.select("context", F.explode(F.array(F.struct(F.lit("required").alias("kind"), F.lit("FRANCE").alias("needle")), F.struct(F.lit("stale").alias("kind"), F.lit("no such words").alias("needle")))).alias("n")).select("context", "n.*")
    return retrieval.quality(shown, needed).select("context", "recall", "stale_excluded")
