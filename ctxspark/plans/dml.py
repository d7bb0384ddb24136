"""CREATE, DROP, INSERT, UPDATE and DELETE: rows are validated as DataFrames before a new version is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions import sem
from ctxspark.lang import ast as A
from ctxspark.plans.lower import Lowering, Relation
from ctxspark.sources.catalog import ORD, ROWID, Catalog, CatalogError, positioned

_KIND = {"INTEGER": "int", "INT": "int", "REAL": "real", "FLOAT": "real", "DOUBLE": "real", "BLOB": "blob"}


def coerced(v: sem.Value, declared: str) -> Column:
    """A value as a column of the declared type takes it: whole numbers truncate, text takes anything as text."""
    kind = _KIND.get(declared, "text")
    target = {"int": "bigint", "real": "double", "blob": "binary"}.get(kind, "string")
    if v.kind == "null":
        return F.lit(None).cast(target)
    if kind == "text":
        return v.col if v.kind == "text" else F.when(v.col.isNotNull(), sem.to_text(v))
    if kind == "blob" or v.kind not in sem.NUMBERS:
        if kind != v.kind:
            raise CatalogError(f"Type mismatch: cannot store {v.kind} as {declared}")
        return v.col
    return v.col.cast(target)


class Changes:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def _table(self, name: str) -> dict:
        if name not in self.catalog.state["tables"]:
            raise CatalogError(f"Table is read-only: {name}" if self.catalog.has(name) else f"Unknown table: {name}")
        return self.catalog.state["tables"][name]

    def _relation(self, name: str) -> tuple[DataFrame, Relation]:
        """The table with its hidden columns, and names for expressions over it."""
        df = self.catalog.read(name)
        rel = Lowering(lambda _: df).scan(A.TableRef(name))
        fields = [_own(f) for f in rel.fields]
        return df, Relation(df, fields)

    def insert(self, s: A.Insert) -> int:
        t = self._table(s.table)
        names = [c["name"] for c in t["columns"]]
        columns = s.columns or names
        if unknown := [c for c in columns if c not in names]:
            raise CatalogError(f"Unknown column: {unknown[0]}")
        low, parts = Lowering(self.catalog.read), []
        one = self.spark.range(1)
        for k, row in enumerate(s.rows):
            if len(row) != len(columns):
                raise CatalogError("Column count does not match value count")
            values = {c: low.value(e, Relation(one, [])) for c, e in zip(columns, row)}
            cells = [coerced(values.get(c["name"], sem.Value(F.lit(None), "null")), c["type"]).alias(c["name"]) for c in t["columns"]]
            parts.append(F.struct(*cells, F.lit(k).cast("bigint").alias(ORD)))
        rows = one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
        rows = self.spark.createDataFrame(rows.collect(), rows.schema)  # the statement's own rows
        return self.add(s.table, rows, len(s.rows))

    def add(self, table: str, rows: DataFrame, n: int) -> int:
        """rows: the table's columns and ORD from 0 to n - 1. Only they are written, as one more part, and checked: among
        themselves and against the keys that the table has."""
        t = self._table(table)
        placed = positioned(rows, t["next"], str(t["version"])).select(self.catalog.schema(table).names)
        self.catalog.append(table, placed, n, lambda part: self.validate(table, part, self.catalog.read(table), part))
        return n

    def insert_from(self, table: str, rows: DataFrame) -> int:
        """Bulk load: any DataFrame with (some of) the table's columns. Its rows are written once, so that they stay as
        they are, and numbered without gaps by counts per task of that writing."""
        t = self._table(table)
        cells = [coerced(sem.of(F.col(f"`{c['name']}`"), rows.schema[c["name"]].dataType), c["type"]).alias(c["name"]) if c["name"] in rows.columns else coerced(sem.literal(None), c["type"]).alias(c["name"]) for c in t["columns"]]
        with self.catalog.staged(table, rows.select(*cells, F.monotonically_increasing_id().alias(ORD))) as kept:
            task, place = F.shiftright(ORD, 33), F.col(ORD).bitwiseAND(F.lit((1 << 33) - 1))
            counts = kept.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
            starts = counts.select("__task", F.coalesce(before, F.lit(0)).alias("__start"))  # a row per task
            numbered = kept.join(F.broadcast(starts), task == F.col("__task")).withColumn(ORD, F.col("__start") + place)
            return self.add(table, numbered, kept.count())

    def update(self, s: A.Update) -> int:
        """SET expressions see the old row. Keys are checked on the final state."""
        t = self._table(s.table)
        df, rel = self._relation(s.table)
        types = {c["name"]: c["type"] for c in t["columns"]}
        if unknown := [c for c, _ in s.sets if c not in types]:
            raise CatalogError(f"Unknown column: {unknown[0]}")
        low = Lowering(self.catalog.read)
        hit = sem.truthy(low.value(s.where, rel)) if s.where is not None else F.lit(True)
        sets = {c: F.when(hit, coerced(low.value(e, rel), types[c])).otherwise(F.col(f"`{c}`")).alias(c) for c, e in s.sets}
        after = df.select(*[sets.get(c, F.col(f"`{c}`")) for c in df.columns])
        n = df.where(hit).count()
        if n:
            changed = after.join(df.where(hit).select(ROWID), ROWID, "left_semi")
            self.validate(s.table, changed, None, after)
            for c in sets:
                self.restrict(s.table, c, after)
            self.catalog.replace(s.table, after)
        return n

    def delete(self, s: A.Delete) -> int:
        self._table(s.table)
        df, rel = self._relation(s.table)
        hit = sem.truthy(Lowering(self.catalog.read).value(s.where, rel)) if s.where is not None else F.lit(True)
        n = df.where(hit).count()
        if n:
            after = df.where(~hit)
            for c in {k["foreign"][1] for _, k in self.catalog.referrers(s.table)}:
                self.restrict(s.table, c, after)
            self.catalog.replace(s.table, after)
        return n

    def validate(self, table: str, changed: DataFrame, before: DataFrame | None, after: DataFrame) -> None:
        """NOT NULL and foreign keys of the changed rows; the primary key of all rows after the change, or, where rows only
        come to those before, of the new ones among themselves and against the others. after may be the new rows alone."""
        for c in self._table(table)["columns"]:
            col = F.col(f"`{c['name']}`")
            if (c["not_null"] or c["primary"]) and changed.where(col.isNull()).limit(1).count():
                raise CatalogError(f"Column {c['name']} cannot be NULL")
            if c["primary"]:
                keys = after.select(col.alias("k"))
                twice = keys.groupBy("k").count().where("count > 1").limit(1).count()
                if twice or before is not None and before.select(col.alias("k")).join(keys, "k", "left_semi").limit(1).count():
                    raise CatalogError(f"Duplicate primary key in {table}.{c['name']}")
            if c["foreign"]:
                own = after if before is None else before.unionByName(after)
                there = own if c["foreign"][0] == table else self.catalog.read(c["foreign"][0])
                keys = there.select(F.col(f"`{c['foreign'][1]}`").alias("k"))
                if changed.where(col.isNotNull()).select(col.alias("k")).join(keys, "k", "left_anti").limit(1).count():
                    raise CatalogError(f"Foreign key violation: {table}.{c['name']} -> {c['foreign'][0]}.{c['foreign'][1]}")

    def restrict(self, table: str, column: str, after: DataFrame) -> None:
        """Values of the column that go must not be referenced."""
        gone = self.catalog.read(table).select(F.col(f"`{column}`").alias("k")).join(after.select(F.col(f"`{column}`").alias("k")), "k", "left_anti")
        for other, c in self.catalog.referrers(table):
            if c["foreign"][1] == column:
                users = (after if other == table else self.catalog.read(other)).select(F.col(f"`{c['name']}`").alias("k"))
                if gone.join(users, "k", "left_semi").limit(1).count():
                    raise CatalogError(f"Row is referenced by {other}.{c['name']}")


def _own(f):
    from dataclasses import replace

    return replace(f, column=f"`{f.name}`")
