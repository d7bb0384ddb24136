"""Snapshot statements on a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions import sem
from ctxspark.lang import ast as A
from ctxspark.lang.sqlgen import select_sql
from ctxspark.operators import snapshot as S
from ctxspark.plans.lower import Lowering
from ctxspark.sources.catalog import ROWID, Catalog, CatalogError


def pairs(spark, items: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(a, str(b)) for a, b in items], "field string, value string")


class Snapshots:
    """A snapshot keeps row identities and splits, not values; batches read the table as it is now."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def meta(self, name: str) -> dict:
        if name not in self.catalog.state["snapshots"]:
            raise CatalogError(f"Unknown snapshot: {name}")
        return self.catalog.state["snapshots"][name]

    def identified(self, table: str) -> DataFrame:
        """The table with rowid: a managed table's own, else a digest of all columns and the number of the row among
        those that are equal to it. Equal rows are numbered within each task of the scan first, and then by the counts
        of the tasks, so no task sees all copies of a row."""
        df = self.catalog.read(table)
        if ROWID in df.columns:
            return df.withColumn("rowid", F.col(ROWID))
        cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        rows = df.withColumn("__d", F.md5(cells)).withColumn("__t", F.spark_partition_id())
        counts = rows.groupBy("__d", "__t").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__d").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
        starts = counts.select(F.col("__d").alias("__e"), F.col("__t").alias("__u"), F.coalesce(before, F.lit(0)).alias("__s"))
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.lit(0))))
        rows = rows.join(starts, (F.col("__d") == F.col("__e")) & (F.col("__t") == F.col("__u")))
        rowid = F.concat("__d", F.lit(":"), (F.col("__s") + F.col("__k")).cast("string"))
        return rows.withColumn("rowid", rowid).drop("__d", "__e", "__t", "__u", "__n", "__s", "__k")

    def create(self, s: A.CreateSnapshot) -> DataFrame:
        c, q = self.catalog, s.source
        if s.name in c.state["snapshots"]:
            raise CatalogError(f"Snapshot already exists: {s.name}")
        if q.joins or q.group or q.having is not None or q.limit is not None or q.offset is not None:
            raise CatalogError("a snapshot takes one table with an optional filter")
        columns = [x["name"] for x in c.table(q.table.name)["columns"]]
        star = any(isinstance(e, A.Star) for e in q.items)
        if not all(isinstance(e, (A.Star, A.Column)) for e in q.items):
            raise CatalogError("snapshot features must be projected columns")
        chosen = [e.name for e in q.items if isinstance(e, A.Column)]
        label = s.label or A.Spec(chosen[-1] if chosen else columns[-1] if star else "")
        features = s.features or [A.Spec(n) for n in (columns if star else chosen) if n != label.name]
        split_by = s.split_by or "row"
        if not features or not label.name:
            raise CatalogError("a snapshot requires at least one feature and a label")
        by_row = split_by in ("row", "rowid")
        for kind, names in (("feature", [f.name for f in features]), ("label", [label.name]), ("split key", [] if by_row else [split_by])):
            if missing := [n for n in names if n not in columns]:
                raise CatalogError(f"Unknown {kind} column: {missing[0]}")
        source = self.identified(q.table.name)
        if q.where is not None:
            low = Lowering(lambda _: source)
            rel = low.scan(q.table)
            named = source.select(*[F.col(f"`{f.name}`").alias(f.name) for f in source.schema.fields])
            # the filter is lowered over the same columns under their own names
            test = low.value(q.where, type(rel)(named, [_renamed(f) for f in rel.fields], None))
            source = named.where(sem.truthy(test))
        key = F.col("rowid") if by_row else self._text(source, split_by)
        extra = [self._text(source, "user_id").alias("user_id")] if "user_id" in columns and split_by != "user_id" else []
        rows = S.assign_splits(source.select("rowid", key.alias("key"), *extra), F.col("key"), s.seed)
        state, path = c.draft(), c.new_path("snapshots", s.name)
        rows.write.parquet(str(c.root / path))
        rows = self.spark.read.schema(rows.schema).parquet(str(c.root / path))
        warnings = []
        if not by_row and (r := S.leakage(rows, "key").first()):
            warnings.append(f"leakage-check sus: split key '{r['key']}' appears in multiple splits")
        if extra and (r := S.leakage(rows, "user_id").first()):
            warnings.append(f"leakage-check sus: user_id '{r['user_id']}' appears in multiple splits; prefer split-by user_id")
        n = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
        state["snapshots"][s.name] = {"name": s.name, "table": q.table.name, "query": select_sql(q), "fingerprint": c.fingerprint, "table_version": c.revision, "split_by": split_by, "seed": s.seed, "features": [vars(f) for f in features], "label": vars(label), "warnings": warnings, "path": path}
        c.publish(state)
        out = [("snapshot", s.name), ("rows", sum(n.values())), ("train_rows", n.get("train", 0)), ("validation_rows", n.get("validation", 0)), ("test_rows", n.get("test", 0)), ("split_by", split_by), ("seed", s.seed), ("features", ",".join(f.name for f in features)), ("label", label.name)]
        return pairs(self.spark, out + ([("warning", " | ".join(warnings))] if warnings else []))

    @staticmethod
    def _text(df: DataFrame, name: str):
        return sem.to_text(sem.of(F.col(f"`{name}`"), df.schema[name].dataType))

    def members(self, name: str) -> DataFrame:
        """(rowid, split) of a snapshot."""
        return self.spark.read.parquet(str(self.catalog.root / self.meta(name)["path"])).select("rowid", "split")

    def plan(self, name: str, epoch: int = 0, rank: int = 0, world_size: int = 1, split: str = "train") -> DataFrame:
        return S.epoch_plan(self.members(name).where(F.col("split") == split), self.meta(name)["seed"], epoch, rank, world_size)

    def rows(self, name: str, plan: DataFrame) -> DataFrame:
        """plan with the values that the table has now; rows that are gone are left out."""
        return plan.join(self.identified(self.meta(name)["table"]), "rowid")

    def ship(self, s: A.ShipTorch) -> DataFrame:
        plan = self.plan(s.dataset, s.epoch, s.rank, s.world_size)
        n, batches = plan.agg(F.count("*"), S.batches_of(plan, s.batch_size)).first()
        reader = f'BatchReader(engine, dataset="{s.dataset}", batch_size={s.batch_size})'
        return pairs(self.spark, [("snapshot", s.dataset), ("torch_dataset", "from ctxspark.operators.snapshot import BatchReader"), ("python", reader), ("samples", n), ("batches", batches), ("batch_size", s.batch_size), ("shuffle", "deterministic" if s.deterministic else "off"), ("epoch", s.epoch), ("rank", s.rank), ("world_size", s.world_size)])

    def explain(self, name: str, batch_size: int, epoch: int = 0, number: int = 0, rank: int = 0, world_size: int = 1) -> DataFrame:
        meta = self.meta(name)
        part = S.batch(self.plan(name, epoch, rank, world_size), batch_size, number)
        ids = [r.rowid for r in part.orderBy("position").select("rowid").collect()]  # one batch
        source = self.identified(meta["table"])
        label = self._text(source, meta["label"]["name"])
        counts = part.join(source, "rowid").groupBy(label.alias("label")).count().orderBy("label").collect()
        out = [("snapshot", name), ("batch", number), ("samples", len(ids)), ("source_rows", ",".join(ids))]
        out += [("source_range", f"{ids[0]}-{ids[-1]}")] if ids else []
        out += [("feature_columns", ",".join(f["name"] for f in meta["features"])), ("label_distribution", ",".join(f"{r.label}={r['count']}" for r in counts)), ("split", "train"), ("seed", meta["seed"]), ("epoch", epoch), ("rank", f"{rank}/{world_size}"), ("worker", "0"), ("resume_token", f"{name}:epoch={epoch}:batch={number}:rank={rank}")]
        return pairs(self.spark, out)


def _renamed(f):
    from dataclasses import replace

    return replace(f, column=f"`{f.name}`")
