"""Which row is which: bulk loads in order, inserts that write only new rows, repeated rows of outside tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ctxspark.sources.catalog import ORD, CatalogError


def test_rows_after_a_bulk_load_come_after_it(engine, spark):
    engine.execute("manifest t (id INTEGER main-character)")
    assert engine.changes.insert_from("t", spark.range(20_000).repartition(7)) == 20_000
    engine.execute("yeet-into t drip (20000)")
    rows = engine.catalog.read("t").select("id", ORD).collect()
    assert sorted(r[ORD] for r in rows) == list(range(20_001))
    assert max(rows, key=lambda r: r[ORD]).id == 20_000


def test_inserts_write_new_rows_only_and_parts_are_joined(engine, spark, monkeypatch):
    from ctxspark.sources import catalog

    monkeypatch.setattr(catalog, "MOST_PARTS", 4)
    engine.execute("manifest t (id INTEGER main-character)")
    changes, sizes = engine.changes, []
    for k in range(5):
        changes.insert_from("t", spark.range(10 * k, 10 * k + 10))
        paths = engine.catalog.state["tables"]["t"]["paths"]
        sizes.append((len(paths), spark.read.parquet(str(engine.catalog.root / paths[-1])).count()))
    assert sizes == [(2, 10), (3, 10), (4, 10), (1, 40), (2, 10)]
    with pytest.raises(CatalogError, match="Duplicate"):
        changes.insert_from("t", spark.createDataFrame([(7,)], "id bigint"))
    with pytest.raises(CatalogError, match="Duplicate"):
        changes.insert_from("t", spark.createDataFrame([(70,), (70,)], "id bigint"))
    with pytest.raises(CatalogError, match="NULL"):
        changes.insert_from("t", spark.createDataFrame([(None,)], "id bigint"))
    assert sorted(r.id for r in engine.catalog.read("t").collect()) == list(range(50))
    assert len(os.listdir(engine.catalog.root / "tables/t")) >= 2


def test_repeated_rows_of_an_outside_table_keep_their_number(engine, spark, tmp_path):
    rows = [(1, "a", None), (1, "a", None), (1, "a", None), (2, "b", 0.5), (2, "b", None), (3, "", -0.0)] + [(9, "hot", 1.0)] * 500
    path = str(tmp_path / "outside.parquet")
    spark.createDataFrame(rows, "user_id bigint, text string, x double").repartition(6).write.parquet(path)
    engine.register("outside", path)
    once, again = (Counter(r.rowid for r in engine.snapshots.identified("outside").select("rowid").collect()) for _ in range(2))
    assert once == again and len(once) == len(rows)
    got = engine.snapshots.identified("outside").where("user_id = 9").select(F.split("rowid", ":")[1].cast("int").alias("k")).collect()
    assert sorted(r.k for r in got) == list(range(1, 501))


def test_loader_workers_share_the_batches(engine):
    from ctxspark.operators.snapshot import BatchReader

    engine.execute("manifest c (id INTEGER main-character, y INTEGER); yeet-into c drip " + ",".join(f"({i},{i % 3})" for i in range(60)))
    engine.execute("manifest-snapshot s lowkey slay id, y no-cap c split-by row with-seed 42")
    ids = lambda **k: [list(map(int, b["id"])) for b in BatchReader(engine, "s", batch_size=7, **k)]
    whole, parts = ids(), [ids(worker=w, workers=3) for w in range(3)]
    assert [parts[k % 3][k // 3] for k in range(len(whole))] == whole and sum(map(len, parts)) == len(whole) > 5


def test_parts_of_a_context_are_joined(engine, spark, monkeypatch):
    from ctxspark.context.store import RAW
    from ctxspark.sources import catalog

    monkeypatch.setattr(catalog, "MOST_PARTS", 3)
    engine.execute("manifest-context c")
    sizes = []
    for k in range(5):
        engine.contexts.load("c", spark.createDataFrame([("c", 0, k, "user", f"I like tea {k}.", "", False)], RAW))
        sizes.append(len(engine.catalog.state["contexts"]["c"]["parts"]))
    rows = engine.contexts.messages("c").orderBy("ordinal").collect()
    assert sizes == [1, 2, 3, 1, 2] and [r.message_id for r in rows] == list(range(5)) and [r.ordinal for r in rows] == list(range(5))
