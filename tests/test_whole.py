"""Queries over whole tables against plain models."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import pytest

from ctxspark import queries as own
from ctxspark.context import rules as R
from tests.conftest import SF
from tests.test_context import naive_status, plain_atoms


@pytest.fixture(scope="module")
def said():
    """(context, message_id, text, atoms) of every message in order, by SQL and the plain model."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return [(*r, plain_atoms(r[2])) for r in con.execute(f"WITH {own._MESSAGES} SELECT context, message_id, text FROM m ORDER BY message_id").fetchall()]


@pytest.fixture(scope="module")
def atoms(said):
    """(message_id, context, key, value, type, confidential, start, end, status, invalidated_by) of each atom."""
    rows = [(i, c, a, any(t in text.lower() for t in R.CONFIDENTIAL_TERMS)) for c, i, text, found in said for a in found]
    status = naive_status([(a[0], c, a[1], f"message_{i}") for i, c, a, _ in rows])
    return [(i, c, a[0], a[1], a[2], hidden, a[5], a[6], *s) for (i, c, a, hidden), s in zip(rows, status)]


def points(key, value, kind):
    q, v = own.QUERY_TEXT, value.lower()
    n = 10 + 40 * (v in q) + min(80, 20 * sum(t in v for t in ("recommend", "quiet", "restaurant", "france")))
    n += 100 * (key == "user_location") + {"constraint": 80, "task": 50, "decision": 70}.get(kind, 0)
    return n + (60 + 90 * any(t in v for t in R.FOOD_VALUE)) * (kind == "preference")


def shown(a):
    return f"{a[4]} {a[2]}={R.REDACTED if a[5] else a[3]}"


def rows_of(spark, name):
    return Counter(map(tuple, own.QUERIES[name](spark, SF).collect()))


def test_memory_over_every_message(spark, said, atoms):
    assert {a[4] for a in atoms} >= {"decision", "question", "debug"} and any(not found for *_, found in said)
    assert rows_of(spark, "extract_atoms") == Counter((a[0], a[2], a[3]) for a in atoms)
    assert rows_of(spark, "invalidate_window") == Counter((a[0], a[2], a[8], a[9]) for a in atoms)
    assert rows_of(spark, "utility_rank") == Counter((a[0], points(*a[2:5])) for a in atoms if a[8] == "active")
    newest = {(a[4], a[2], a[3].lower()): a[0] for a in atoms}
    assert rows_of(spark, "diversity_dedupe") == Counter((i, k, v) for (_, k, v), i in newest.items())
    assert rows_of(spark, "redact_render") == Counter((a[0], shown(a)) for a in atoms)


def test_objects_tabs_and_counts_of_every_message(spark, said, atoms):
    assert rows_of(spark, "show_tabs") == Counter([("main", str(len(said)), str(len(atoms)), str(max(m[1] for m in said)))])
    want = Counter(("ContextAtom", f"message_{a[0]}", shown(a), f"{a[6]}:{a[7]}") for a in atoms)
    for _, i, text, _ in said:
        hidden = any(t in text.lower() for t in R.CONFIDENTIAL_TERMS)
        want["ConversationMessage", f"message_{i}", R.REDACTED if hidden else text, f"0:{len(text.encode())}"] += 1
    assert rows_of(spark, "show_objects") == want
    by = defaultdict(Counter)
    for a in atoms:
        by[a[1]][a[8]] += 1
    assert rows_of(spark, "explain_counts") == Counter((c, n.total(), n["invalidated"], n["active"]) for c, n in by.items())


def test_ordered_and_ranked_rows_are_not_capped(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice").collect()
    got = own.QUERIES["rank_after_filter"](spark, SF).collect()
    high = [o for o in orders if o.o_totalprice > 100000]
    prices = defaultdict(list)
    for o in high:
        prices[o.o_orderstatus].append(o.o_totalprice)
    want = [(o.o_orderkey, 1 + sum(p < o.o_totalprice for p in prices[o.o_orderstatus])) for o in sorted(high, key=lambda o: o.o_orderkey)]
    assert [tuple(r) for r in got] == want and len(got) > 50
    got = own.QUERIES["order_alias"](spark, SF).collect()
    assert [r.o_orderkey for r in got] == [o.o_orderkey for o in sorted(orders, key=lambda o: (-o.o_totalprice, o.o_orderkey))]
    got = own.QUERIES["order_multi"](spark, SF).collect()
    nations = spark.read.parquet(f"{SF}/nation.parquet").collect()
    assert [r.n_name for r in got] == [n.n_name for n in sorted(nations, key=lambda n: (-n.n_regionkey, n.n_name))]
