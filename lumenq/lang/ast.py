"""Syntax tree. Every node is immutable; equal text gives equal trees."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """Base of all nodes."""


# --- expressions ---------------------------------------------------------------


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Param(Node):
    index: int


@dataclass(frozen=True)
class Default(Node):
    """The DEFAULT keyword among inserted values."""


@dataclass(frozen=True)
class ColumnRef(Node):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Node):
    arg: Node
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Is(Node):
    """what: None, True or False."""

    arg: Node
    what: bool | None
    negated: bool = False


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    star: bool = False


@dataclass(frozen=True)
class ScalarQuery(Node):
    query: Select


# --- queries -------------------------------------------------------------------


@dataclass(frozen=True)
class TableName(Node):
    name: str
    database: str | None = None


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class Source(Node):
    """A table or a derived table."""

    of: TableName | Select
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    """kind: inner, left, right, full or cross."""

    kind: str
    source: Source
    on: Node | None = None


@dataclass(frozen=True)
class Order(Node):
    expr: Node
    ascending: bool = True
    nulls_first: bool = True


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] | str | None = None  # "ALL", keys or no grouping
    having: Node | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None


# --- commands ------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnDef(Node):
    name: str
    type: str
    length: int | None = None
    not_null: bool = False
    primary_key: bool = False
    comment: str = ""


@dataclass(frozen=True)
class Insert(Node):
    table: TableName
    columns: tuple[str, ...]
    rows: tuple[tuple[Node, ...], ...] = ()
    query: Select | None = None


@dataclass(frozen=True)
class Update(Node):
    table: TableName
    alias: str | None
    sets: tuple[tuple[str, Node], ...]
    where: Node | None = None


@dataclass(frozen=True)
class Delete(Node):
    table: TableName
    alias: str | None
    where: Node | None = None


@dataclass(frozen=True)
class CreateDatabase(Node):
    name: str
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropDatabase(Node):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class RenameDatabase(Node):
    name: str
    to: str


@dataclass(frozen=True)
class CreateTable(Node):
    table: TableName
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Node):
    table: TableName
    if_exists: bool = False


@dataclass(frozen=True)
class AlterTable(Node):
    """action: rename, add, drop, rename_column, set_default, drop_default, set_not_null, drop_not_null or set_type."""

    table: TableName
    action: str
    column: str | None = None
    to: str | None = None
    definition: ColumnDef | None = None
    default: Node | None = None
    if_exists: bool = False


@dataclass(frozen=True)
class CreateIndex(Node):
    name: str
    table: TableName
    column: str
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropIndex(Node):
    name: str
    table: TableName | None = None
    if_exists: bool = False


@dataclass(frozen=True)
class Show(Node):
    """what: databases or tables."""

    what: str


@dataclass(frozen=True)
class Describe(Node):
    table: TableName


@dataclass(frozen=True)
class Use(Node):
    name: str


@dataclass(frozen=True)
class Transaction(Node):
    """what: begin, commit or rollback."""

    what: str
