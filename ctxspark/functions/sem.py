"""Value semantics of the dialect as Columns of a statically known kind.

Integers, reals and booleans compare as numbers; text compares by bytes; values of unlike kinds are never coerced. Logic
is two-valued: NULL counts as false, so NOT (x = NULL) is true. Division by zero is NULL. None of these expressions
depends on the session's ANSI setting."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("int", "real", "bool")
#: Order of values of unlike kinds.
_TAG = {"int": 1, "real": 2, "text": 3, "bool": 4, "blob": 5}


class EvalError(ValueError):
    """A query that cannot be evaluated."""


@dataclass
class Value:
    """kind: int, real, text, bool, blob or null"""

    col: Column
    kind: str


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    if isinstance(data_type, T.NullType):
        return "null"
    return "text"


def of(col: Column, data_type: T.DataType) -> Value:
    """A table's column: integers as bigint, reals as double; types that the dialect lacks (dates, say) as their text."""
    kind = kind_of(data_type)
    if kind in ("int", "real"):
        col = col.cast("bigint" if kind == "int" else "double")
    elif kind == "text" and not isinstance(data_type, T.StringType):
        col = col.cast("string")
    return Value(col, kind)


def literal(x) -> Value:
    if x is None:
        return Value(F.lit(None), "null")
    if isinstance(x, bool):
        return Value(F.lit(x), "bool")
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), "int")
    return Value(F.lit(x), "real" if isinstance(x, float) else "text")


def truthy(v: Value) -> Column:
    """NULL is false; a number is true unless zero; a text unless empty."""
    if v.kind == "null":
        return F.lit(False)
    test = {"bool": lambda: v.col, "int": lambda: v.col != 0, "real": lambda: v.col != 0}.get(v.kind, lambda: F.length(v.col) > 0)()
    return F.coalesce(test, F.lit(False))


def logic(op: str, a: Value, b: Value) -> Value:
    return Value(truthy(a) & truthy(b) if op == "AND" else truthy(a) | truthy(b), "bool")


def negate(v: Value) -> Value:
    return Value(~truthy(v), "bool")


def _number(v: Value) -> Column:
    return v.col.cast("bigint") if v.kind == "bool" else v.col


def compare(op: str, a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        return Value(F.lit(None).cast("boolean"), "bool")
    if a.kind in NUMBERS and b.kind in NUMBERS:
        x, y = _number(a), _number(b)
    elif a.kind == b.kind:
        x, y = a.col, b.col
    else:
        x, y = F.lit(_TAG[a.kind]), F.lit(_TAG[b.kind])
        test = {"=": F.lit(False), "!=": F.lit(True)}.get(op)
        test = _compare(op, x, y) if test is None else test
        return Value(F.when(a.col.isNotNull() & b.col.isNotNull(), test), "bool")
    return Value(_compare(op, x, y), "bool")


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"=": x.__eq__, "!=": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if "null" in (a.kind, b.kind):
        return Value(F.lit(None), "null")
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        raise EvalError("Arithmetic requires numeric values")
    whole = a.kind != "real" and b.kind != "real"
    x, y = (_number(v) if whole else _number(v).cast("double") for v in (a, b))
    if op == "/":
        y = F.nullif(y, F.lit(0).cast("bigint") if whole else F.lit(0.0))
        return Value(F.call_function("div", x, y) if whole else x / y, "int" if whole else "real")
    return Value({"+": x.__add__, "-": x.__sub__, "*": x.__mul__}[op](y), "int" if whole else "real")


def minus(v: Value) -> Value:
    if v.kind == "null":
        return v
    if v.kind not in NUMBERS:
        raise EvalError("Arithmetic requires numeric values")
    return Value(-_number(v), "real" if v.kind == "real" else "int")


@F.pandas_udf(T.StringType())
def real_text(x: pd.Series) -> pd.Series:
    """15 significant digits, as C's %.15g has them."""
    return x.map(lambda v: None if pd.isna(v) else format(v, ".15g"))


def to_text(v: Value) -> Column:
    """NULL as the word, booleans as 1 and 0."""
    if v.kind == "null":
        return F.lit("NULL")
    col = {"bool": lambda: v.col.cast("int").cast("string"), "real": lambda: real_text(v.col), "blob": lambda: F.concat(F.lit("0x"), F.lower(F.hex(v.col)))}.get(v.kind, lambda: v.col.cast("string"))()
    return F.coalesce(col, F.lit("NULL"))


def concat(a: Value, b: Value) -> Value:
    return Value(F.concat(to_text(a), to_text(b)), "text")
