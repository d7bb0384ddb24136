"""The engine: statements in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ctxspark.context.store import Contexts
from ctxspark.lang import ast as A
from ctxspark.lang.parser import parse
from ctxspark.lang.rewrite import Report, rewrite
from ctxspark.lang.sqlgen import to_sql
from ctxspark.plans.dml import Changes
from ctxspark.plans.lower import Lowering
from ctxspark.plans.snapshots import Snapshots
from ctxspark.sources.catalog import Catalog


@dataclass
class Result:
    """df: rows of a query or report, or nothing; affected: rows of a change."""

    df: DataFrame | None = None
    affected: int = 0
    message: str = ""

    def rows(self) -> list:
        return self.df.collect() if self.df is not None else []


@lru_cache(maxsize=128)
def _parsed(text: str) -> tuple:
    return tuple(parse(text))


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.changes, self.snapshots, self.contexts = Changes(self.catalog), Snapshots(self.catalog), Contexts(self.catalog)
        self.report = Report()

    def begin(self) -> None:
        self.catalog.begin()

    def commit(self) -> None:
        self.catalog.commit()

    def rollback(self) -> None:
        self.catalog.rollback()

    def register(self, name: str, path: str) -> None:
        self.catalog.register(name, path)

    def execute(self, text: str) -> list[Result]:
        """Each statement of a script, in order. One statement at a time changes a catalog."""
        with self.catalog.lock:
            return [self.run(s) for s in _parsed(text)]

    def sql(self, text: str) -> DataFrame:
        """The rows of the last statement."""
        return self.execute(text)[-1].df

    def transpile(self, text: str) -> str:
        return "\n".join(to_sql(s) for s in _parsed(text))

    def run(self, s) -> Result:
        c = self.catalog
        if isinstance(s, A.Select):
            columns = c.table(s.table.name)["columns"] if not s.joins else None
            s, self.report = rewrite(s, columns)
            return Result(Lowering(c.read).select(s))
        if isinstance(s, A.CreateTable):
            c.create(s.table, [{**vars(x), "foreign": list(x.foreign) if x.foreign else None} for x in s.columns], s.if_not_exists)
            return Result(message=f"created table {s.table}")
        if isinstance(s, A.DropTable):
            c.drop(s.table, s.if_exists)
            return Result(message=f"dropped table {s.table}")
        for kind, change, word in ((A.Insert, self.changes.insert, "inserted"), (A.Update, self.changes.update, "updated"), (A.Delete, self.changes.delete, "deleted")):
            if isinstance(s, kind):
                n = change(s)
                return Result(affected=n, message=f"{word} {n} row(s)")
        x, n = self.contexts, self.snapshots
        rules = {A.CreateSnapshot: n.create, A.ShipTorch: n.ship, A.SpillBatch: lambda s: n.explain(s.dataset, s.batch_size, s.epoch, s.batch, s.rank, s.world_size), A.CreateContext: lambda s: x.create(s.name), A.AppendMemory: x.append, A.SpillContext: x.spill, A.ExplainContext: x.explain, A.TagMemory: x.retag, A.ShowTabs: lambda s: x.show_tabs(s.context), A.ShowSchemas: lambda s: x.show_schemas(), A.ShowObjects: lambda s: x.show_objects(s.context), A.AliasTab: x.alias, A.MergeTabs: x.merge}
        return Result(rules[type(s)](s))
