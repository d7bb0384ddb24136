"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Expr:
    alias: str | None = field(default=None, kw_only=True)


@dataclass
class Literal(Expr):
    """value: int, float, str or None."""

    value: Any


@dataclass
class Column(Expr):
    name: str
    table: str | None = None


@dataclass
class Star(Expr):
    table: str | None = None


@dataclass
class Unary(Expr):
    """op: NOT or -"""

    op: str
    operand: Expr


@dataclass
class Binary(Expr):
    """op: OR, AND, a comparison, + - * / or ||"""

    op: str
    left: Expr
    right: Expr


@dataclass
class Call(Expr):
    """name: the dialect's word for an aggregate, or any other name."""

    name: str
    args: list[Expr]
    distinct: bool = False


@dataclass
class Order:
    expr: Expr
    ascending: bool = True


@dataclass
class Rank(Expr):
    partition: list[Expr]
    order: list[Order]


@dataclass
class TableRef:
    name: str
    alias: str | None = None


@dataclass
class Join:
    kind: str  # inner, left
    table: TableRef
    on: Expr


@dataclass
class Select(Expr):
    """As an expression (in parentheses) it is only good for SQL text."""

    items: list[Expr]
    table: TableRef
    joins: list[Join] = field(default_factory=list)
    where: Expr | None = None
    group: list[Expr] = field(default_factory=list)
    having: Expr | None = None
    order: list[Order] = field(default_factory=list)
    limit: Expr | None = None
    offset: Expr | None = None
    distinct: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list[Expr]]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Expr]]
    where: Expr | None


@dataclass
class Delete:
    table: str
    where: Expr | None


@dataclass
class ColumnDef:
    name: str
    type: str
    primary: bool = False
    not_null: bool = False
    foreign: tuple[str, str] | None = None


@dataclass
class CreateTable:
    table: str
    columns: list[ColumnDef]
    if_not_exists: bool = False


@dataclass
class DropTable:
    table: str
    if_exists: bool = False


@dataclass
class Spec:
    name: str
    spec: str = ""


@dataclass
class CreateSnapshot:
    name: str
    source: Select
    split_by: str = ""
    seed: int = 0
    features: list[Spec] = field(default_factory=list)
    label: Spec | None = None


@dataclass
class ShipTorch:
    dataset: str
    batch_size: int = 256
    deterministic: bool = False
    epoch: int = 0
    rank: int = 0
    world_size: int = 1


@dataclass
class SpillBatch:
    dataset: str
    batch_size: int = 256
    epoch: int = 0
    batch: int = 0
    rank: int = 0
    world_size: int = 1


@dataclass
class CreateContext:
    name: str


@dataclass
class AppendMemory:
    context: str
    message_id: int
    speaker: str
    text: str
    tab: str = ""
    auto_tab: bool = False


@dataclass
class SpillContext:
    context: str
    query: str = ""
    tab: str = ""
    token_budget: int = 1200
    receipts: bool = True


@dataclass
class ExplainContext(SpillContext):
    pass


@dataclass
class TagMemory:
    context: str
    message_id: int
    tab: str


@dataclass
class ShowTabs:
    context: str


@dataclass
class ShowSchemas:
    pass


@dataclass
class ShowObjects:
    context: str


@dataclass
class AliasTab:
    context: str
    alias: str
    target: str


@dataclass
class MergeTabs:
    context: str
    source: str
    target: str
