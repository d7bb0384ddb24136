"""SELECT statements as DataFrames. Catalyst does the rest: pushdown, pruning, join order, physical operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions import sem
from ctxspark.functions.sem import EvalError, Value
from ctxspark.lang import ast as A
from ctxspark.lang.rewrite import fold
from ctxspark.operators import aggs
from ctxspark.sources.catalog import ORD, ROWID

AGGREGATES = ("headcount", "stack", "mid", "goat", "L", "LONE-WOLF", "lone-wolf", "mid-fr", "percent-check")
ARG_ROWS = {"biggest-W": True, "biggest-L": False}


@dataclass
class Field:
    table: str
    alias: str | None
    name: str
    column: str  # its name in the DataFrame
    kind: str


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]
    order: str | None = None  # a column that tells the rows' first-come order, if there is one

    def resolve(self, c: A.Column) -> Field:
        """Qualifiers match tables or aliases; names are case-sensitive."""
        found = [f for f in self.fields if f.name == c.name and (c.table is None or c.table in (f.table, f.alias))]
        if not found:
            raise EvalError(f"Unknown column: {c.table + '.' if c.table else ''}{c.name}")
        if len(found) > 1:
            raise EvalError(f"Ambiguous column: {c.name}")
        return found[0]


def bare(e: A.Expr) -> A.Expr:
    return replace(e, alias=None)


def walk(e):
    """All expressions below e, e first; not into ranks' own parts beyond their expressions."""
    yield e
    below = {A.Unary: lambda: [e.operand], A.Binary: lambda: [e.left, e.right], A.Call: lambda: e.args, A.Rank: lambda: [*e.partition, *[o.expr for o in e.order]]}.get(type(e), list)()
    for x in below:
        yield from walk(x)


def has_aggregate(e: A.Expr) -> bool:
    return any(isinstance(x, A.Call) and x.name in AGGREGATES for x in walk(e))


class Lowering:
    """read: name of a table to its DataFrame."""

    def __init__(self, read: Callable[[str], DataFrame]):
        self.read = read
        self._n = 0

    def scan(self, ref: A.TableRef) -> Relation:
        df, k = self.read(ref.name), self._n
        self._n += 1
        fields, columns, order = [], [], None
        for i, f in enumerate(df.schema.fields):
            if f.name in (ROWID, ORD):
                if f.name == ORD:
                    order = f"o{k}"
                    columns.append(F.col(f"`{ORD}`").alias(order))
                continue
            v = sem.of(F.col(f"`{f.name}`"), f.dataType)
            fields.append(Field(ref.name, ref.alias, f.name, f"t{k}_{i}", v.kind))
            columns.append(v.col.alias(f"t{k}_{i}"))
        return Relation(df.select(*columns), fields, order)

    # expressions

    def value(self, e: A.Expr, rel: Relation, known: dict | None = None) -> Value:
        """known: values of whole expressions (group keys, aggregates, ranks) by their bare form."""
        hit = known.get(repr(bare(e))) if known else None
        if hit is not None:
            return hit() if callable(hit) else hit
        if isinstance(e, A.Literal):
            return sem.literal(e.value)
        if isinstance(e, A.Column):
            f = rel.resolve(e)
            if known is not None and (other := known.get(("field", f.column))):
                return other()
            return Value(F.col(f.column), f.kind)
        if isinstance(e, A.Unary):
            v = self.value(e.operand, rel, known)
            return sem.negate(v) if e.op == "NOT" else sem.minus(v)
        if isinstance(e, A.Binary):
            a, b = self.value(e.left, rel, known), self.value(e.right, rel, known)
            if e.op in ("AND", "OR"):
                return sem.logic(e.op, a, b)
            if e.op == "||":
                return sem.concat(a, b)
            return sem.arithmetic(e.op, a, b) if e.op in "+-*/" else sem.compare(e.op, a, b)
        if isinstance(e, A.Call):
            raise EvalError(f"Unsupported function: {e.name}" if e.name not in (*AGGREGATES, *ARG_ROWS) else f"Aggregate is not allowed here: {e.name}")
        if isinstance(e, A.Rank):
            raise EvalError("A window function must be a select item of its own")
        raise EvalError("Unsupported expression")

    def condition(self, e: A.Expr, rel: Relation, known: dict | None = None) -> Column:
        """e as a filter or join condition. These take NULL for false anyway, so comparisons and their AND and OR stay
        bare, and Catalyst sees join keys and what it can push into scans; below NOT the two-valued form stands."""
        if isinstance(e, A.Binary) and e.op in ("AND", "OR"):
            a, b = self.condition(e.left, rel, known), self.condition(e.right, rel, known)
            return a & b if e.op == "AND" else a | b
        v = self.value(e, rel, known)
        return v.col if isinstance(e, A.Binary) and v.kind == "bool" else sem.truthy(v)

    def join(self, left: Relation, j: A.Join) -> Relation:
        right = self.scan(j.table)
        both = Relation(left.df, [*left.fields, *right.fields], left.order)
        test = self.condition(j.on, both)
        return replace(both, df=left.df.join(right.df, test, j.kind))

    def rank(self, e: A.Rank, rel: Relation) -> tuple[Relation, Column]:
        """The rank as a column of the relation, which gets one more for it where there is nothing to partition by."""
        keys = [self.value(p, rel).col for p in e.partition]
        order = [v.asc_nulls_first() if o.ascending else v.desc_nulls_last() for o in e.order for v in [self.value(o.expr, rel).col]]
        if keys:
            return rel, F.rank().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
        first, name = self.value(e.order[0].expr, rel), f"__r{len(rel.df.columns)}"
        if first.kind not in (*sem.NUMBERS, "text"):
            return rel, F.rank().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint")
        x = first.col.cast("int") if first.kind == "bool" else first.col
        return replace(rel, df=aggs.global_rank(rel.df, x, first.kind, e.order[0].ascending, order, name)), F.col(name)

    # SELECT

    def select(self, s: A.Select) -> DataFrame:
        """Result columns carry the statement's names, which may repeat."""
        s = fold(s)
        rel = self.scan(s.table)
        for j in s.joins:
            rel = self.join(rel, j)
        if s.where is not None:
            rel = replace(rel, df=rel.df.where(self.condition(s.where, rel)))
        calls = [x for e in s.items for x in walk(e) if isinstance(x, A.Call)]
        if arg := next((c for c in calls if c.name in ARG_ROWS), None):
            order = F.col(rel.order) if rel.order else None
            rel = replace(rel, df=aggs.arg_row(rel.df, self.value(arg.args[0], rel).col, ARG_ROWS[arg.name], order))
            s = replace(s, items=[A.Star()], group=[], having=None)
        grouped = bool(s.group) or any(has_aggregate(e) for e in [*s.items, *([s.having] if s.having is not None else [])])
        if grouped:
            if any(isinstance(x, A.Rank) for e in s.items for x in walk(e)):
                raise EvalError("A window function cannot stand with aggregates")
            return self.finish(s, *self.aggregate(s, rel))
        items: list[tuple[str, Column]] = []
        for k, e in enumerate(s.items):
            if isinstance(e, A.Star):
                own = [f for f in rel.fields if e.table is None or e.table in (f.table, f.alias)]
                items += [(f.name, F.col(f.column)) for f in own]
            elif isinstance(e, A.Rank):
                rel, place = self.rank(e, rel)
                items.append((e.alias or "RANK", place))
            else:
                items.append((self.label(e, k), self.value(e, rel).col))
        return self.finish(s, rel, items, None)

    @staticmethod
    def label(e: A.Expr, k: int) -> str:
        if e.alias:
            return e.alias
        return e.name if isinstance(e, (A.Column, A.Call)) else f"expr{k + 1}"

    def aggregate(self, s: A.Select, rel: Relation):
        """(relation after grouping, items, known values)"""
        keys = [self.value(g, rel) for g in s.group]
        names = [f"g{i}" for i in range(len(keys))]
        exprs = [*s.items, *([s.having] if s.having is not None else []), *[o.expr for o in s.order]]
        plain: list[Column] = []
        late: list[tuple[str, DataFrame]] = []
        known: dict = {repr(bare(g)): Value(F.col(n), v.kind) for g, n, v in zip(s.group, names, keys)}
        for c in (x for e in exprs for x in walk(e) if isinstance(x, A.Call) and x.name in AGGREGATES):
            if repr(bare(c)) in known:
                continue
            name = f"a{len(known)}"
            column, kind, frame = self.call(c, rel, keys)
            known[repr(bare(c))] = Value(F.col(name), kind)
            if frame is not None:
                late.append((name, frame))
            else:
                plain.append(column.alias(name))
        order = F.col(rel.order) if rel.order else None
        aliases = {e.alias for e in s.items if e.alias}
        ready = set(known)

        def fields(e: A.Expr):
            if repr(bare(e)) in ready:
                return
            if isinstance(e, A.Column):
                yield e
            for x in {A.Unary: lambda: [e.operand], A.Binary: lambda: [e.left, e.right], A.Call: lambda: e.args}.get(type(e), list)():
                yield from fields(x)

        for c in (c for e in exprs for c in fields(e)):
            if c.table is None and c.name in aliases and not any(f.name == c.name for f in rel.fields):
                continue
            f = rel.resolve(c)
            if ("field", f.column) not in known:
                name = f"f{len(known)}"
                known["field", f.column] = lambda name=name, kind=f.kind: Value(F.col(name), kind)
                plain.append(aggs.first_value(F.col(f.column), order).alias(name))
        out = rel.df.groupBy(*[v.col.alias(n) for v, n in zip(keys, names)]).agg(*(plain or [F.count(F.lit(1)).alias("__any")]))
        for name, frame in late:
            out = out.withColumnsRenamed({n: k for n, k in zip(names, aggs.key_names(len(names)))})
            out = aggs.same_keys(out, frame.withColumnRenamed("value", name), len(names), "left")
            out = out.withColumnsRenamed({k: n for n, k in zip(names, aggs.key_names(len(names)))})
        items = [(self.label(e, k), self.value(e, rel, known).col) for k, e in enumerate(s.items) if not isinstance(e, A.Star)]
        if any(isinstance(e, A.Star) for e in s.items):
            raise EvalError("A wildcard cannot stand with aggregates")
        grouped = Relation(out, rel.fields)
        if s.having is not None:
            grouped = replace(grouped, df=out.where(self.condition(s.having, rel, known)))
        return grouped, items, known

    def call(self, c: A.Call, rel: Relation, keys: list[Value]) -> tuple[Column | None, str, DataFrame | None]:
        if c.name == "headcount":
            if not c.args or isinstance(c.args[0], A.Star):
                return F.count(F.lit(1)), "int", None
            x = self.value(c.args[0], rel).col
            return (F.count_distinct(x) if c.distinct else F.count(x)), "int", None
        if not c.args:
            raise EvalError(f"{c.name} needs an argument")
        v = self.value(c.args[0], rel)
        if c.name in ("goat", "L"):
            return (F.max if c.name == "goat" else F.min)(v.col), v.kind, None
        if c.name == "mid-fr":
            return None, "text" if v.kind == "text" else "real", aggs.median(aggs.keyed(rel.df, [k.col for k in keys], v.col), len(keys), v.kind)
        if c.name == "percent-check":
            if len(c.args) != 2:
                raise EvalError("percent-check needs a value and a percentage")
            return None, v.kind, aggs.nearest_rank(aggs.keyed(rel.df, [k.col for k in keys], v.col), len(keys), self.value(c.args[1], Relation(rel.df, [])).col, v.kind)
        if v.kind not in (*sem.NUMBERS, "null"):
            raise EvalError(f"{c.name} requires numeric values")
        x = v.col.cast("int") if v.kind == "bool" else v.col
        if c.name == "stack":
            return F.sum(x.cast("bigint") if v.kind in ("int", "bool", "null") else x), "real" if v.kind == "real" else "int", None
        if c.name == "mid":
            return F.avg(x), "real", None
        return None, "int", aggs.outliers(aggs.keyed(rel.df, [k.col for k in keys], x), len(keys))

    def finish(self, s: A.Select, rel: Relation, items: list[tuple[str, Column]], known: dict | None) -> DataFrame:
        """DISTINCT, ORDER BY (input columns first, then output names), LIMIT and OFFSET, and the names."""
        df = rel.df
        out = [c.alias(f"c{k}") for k, (_, c) in enumerate(items)]
        order = []
        for k, o in enumerate(s.order):
            if isinstance(o.expr, A.Column) and o.expr.table is None and not any(f.name == o.expr.name for f in rel.fields):
                at = next((i for i, (n, _) in enumerate(items) if n == o.expr.name), None)
                if at is None:
                    raise EvalError(f"Unknown column: {o.expr.name}")
                column = items[at][1]
            else:
                column = self.value(o.expr, rel, known).col
            order.append((column.alias(f"s{k}"), o.ascending))
        first = [F.col(rel.order).alias("s_first")] if rel.order and known is None else []
        df = df.select(*out, *[c for c, _ in order], *first)
        names = [f"c{k}" for k in range(len(items))]
        if s.distinct:
            df = df.dropDuplicates(names)
        if order:
            keys = [F.col(f"s{k}").asc_nulls_first() if up else F.col(f"s{k}").desc_nulls_last() for k, (_, up) in enumerate(order)]
            df = df.orderBy(*keys, *(["s_first"] if first else []))
        if s.offset is not None:
            df = df.offset(self.whole(s.offset, 0))
        if s.limit is not None:
            df = df.limit(self.whole(s.limit, 0))
        return df.select(*names).toDF(*[n for n, _ in items])

    @staticmethod
    def whole(e: A.Expr, otherwise: int) -> int:
        """A folded literal as a count; anything else is zero."""
        return max(0, int(e.value)) if isinstance(e, A.Literal) and isinstance(e.value, (int, float)) else otherwise
