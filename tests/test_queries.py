"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ctxspark import queries as own
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_matches_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF)
    cur = duck.execute(own.ORACLES[name])
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == normal([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(own.QUERIES) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    own.QUERIES["filter_cmp"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_totalprice,200000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_equality_among_other_conditions_is_a_join_key(spark, capsys):
    own.run(spark, SF, "slay c.c_name no-cap customer lowkey c left-link-up orders lowkey o fr-fr c.c_custkey = o.o_custkey plus o.o_totalprice > 10").explain()
    assert "NestedLoop" not in capsys.readouterr().out
