"""The intermediate representation of the SQL subset, as immutable values.

Equality is that of structural matching: what only execution needs (aliases,
directions of single sort keys) does not take part in comparisons.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass

#: The enumerations of the subset; positions are the ids used in it.
CLAUSES = ("select", "from", "where", "group", "order", "limit", "intersect", "union", "except")
JOINS = ("join", "on", "as")
COMPARISONS = ("not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists")
ARITHMETIC = ("none", "-", "+", "*", "/")
AGGREGATES = ("none", "max", "min", "count", "sum", "avg")
CONNECTORS = ("and", "or")
SET_OPS = ("intersect", "union", "except")
DIRECTIONS = ("desc", "asc")


@dataclass(frozen=True)
class Column:
    """A column reference with an optional aggregate: ``agg`` is an id."""

    agg: int
    name: str  # __all__ or __table.column__
    distinct: bool | None = False
    via: str | None = field(default=None, compare=False)  # alias as written


@dataclass(frozen=True)
class Value:
    """One column, or two joined by an arithmetic operator."""

    op: int
    left: Column
    right: Column | None = None


@dataclass(frozen=True)
class Condition:
    negated: bool
    op: int
    unit: Value
    low: object = None  # float, quoted string, Column, Value, Query, tuple or None
    high: object = None


@dataclass(frozen=True)
class Source:
    """A base table, or a derived one."""

    table: str | None  # __table__
    query: Query | None = None
    alias: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Query:
    distinct: bool | None = False
    items: tuple[tuple[int, Value], ...] = ()
    sources: tuple[Source, ...] = ()
    joins: tuple = ()  # conditions and connectors in turn
    where: tuple = ()
    group: tuple[Column, ...] = ()
    having: tuple = ()
    order: tuple = ()  # () or (direction, values)
    limit: int | None = None
    set_op: tuple[str, Query] | None = None
    directions: tuple[str, ...] = field(default=(), compare=False)
    on_sizes: tuple[int, ...] = field(default=(), compare=False)  # items of ``joins`` for each source

    def operand(self, op: str) -> Query | None:
        return self.set_op[1] if self.set_op and self.set_op[0] == op else None


EMPTY = Query()


def conditions(flat: tuple) -> list[Condition]:
    """The condition places of a flat list, connectors left out."""
    return list(flat[::2])


def connectors(flat: tuple) -> list:
    return list(flat[1::2])


def to_json(node: object) -> str:
    """A canonical text of any node, for a string column."""

    def plain(x: object) -> object:
        if is_dataclass(x):
            return {f.name: plain(getattr(x, f.name)) for f in fields(x) if f.compare}
        if isinstance(x, (tuple, list)):
            return [plain(y) for y in x]
        return x

    return json.dumps(plain(node), ensure_ascii=False, sort_keys=True)
