"""Statements that differ only in their literals, run together.

A statement is taken apart into a template, the query with parameters in place
of literals, and its values.  All statements of a template are one plan: a
table of values joins the query's tables where the literals stood, and the
number of the statement goes along through grouping, DISTINCT, sorting and
LIMIT.  ``o_custkey = 17`` of ten thousand statements becomes one equi-join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import types as T

from querent.plans.compiler import _NUMBER, _TIME, Compiler
from querent.plans.ir import COMPARISONS, Column, Condition, Query, Source, conditions, connectors


@dataclass(frozen=True)
class Param:
    """The place of a literal: its number, and the type that it is compared as."""

    index: int
    kind: str


class Types:
    """The types of a catalog's columns, without its DataFrames."""

    def __init__(self, types: Mapping[tuple[str, str], T.DataType]):
        self.types = dict(types)


def literal_of(x: object, kind: T.DataType) -> tuple[str, str] | None:
    """The value as text and the type to compare it as; None for a text that is no such value."""
    if isinstance(x, str):
        text = x.strip('"')
        if isinstance(kind, _TIME):
            return text, "timestamp_ntz"
        if not isinstance(kind, _NUMBER):
            return text, "string"
        try:
            x = float(text)
        except ValueError:
            return None
    whole = float(x).is_integer() and abs(x) < 2**53  # type: ignore[arg-type]
    text = str(int(x)) if whole else repr(x)  # type: ignore[call-overload]
    return text, ("bigint" if whole else "double") if isinstance(kind, _NUMBER) else "string"


def renamed(q: Query) -> Query:
    """Aliases by their order in the text, so that statements that differ in names only are one."""
    names: dict[str, str] = {}

    def find(x: object) -> None:
        if isinstance(x, Source) and x.alias:
            names.setdefault(x.alias, f"t{len(names) + 1}")
        if is_dataclass(x):
            for f in fields(x):
                find(getattr(x, f.name))
        elif isinstance(x, tuple):
            for y in x:
                find(y)

    def put(x: object) -> object:
        if isinstance(x, Source):
            return replace(x, alias=names.get(x.alias or ""), query=put(x.query))
        if isinstance(x, Column):
            return replace(x, via=names.get(x.via, x.via) if x.via else x.via)
        if is_dataclass(x):
            return replace(x, **{f.name: put(getattr(x, f.name)) for f in fields(x)})  # type: ignore[type-var]
        return tuple(put(y) for y in x) if isinstance(x, tuple) else x

    find((q.sources, q))
    return put(q)  # type: ignore[return-value]


def is_simple(q: Query) -> bool:
    """Whether statements of the query's template can be run together: one block, without nested queries."""
    if q.set_op or any(s.query is not None for s in q.sources) or not q.sources:
        return False
    flat = [c for part in (q.joins, q.where, q.having) for c in conditions(part)]
    if any(isinstance(v, Query) for c in flat for v in (c.low, c.high)):
        return False
    stars = [v for a, v in q.items if not a and not v.left.agg and v.left.name == "__all__"]
    return not stars or len(q.items) == 1 and not q.distinct and not q.group


def abstract(q: Query, types: Types) -> tuple[Query, list[str]]:
    """The template of a simple query, and the values of its parameters."""
    compiler, values = Compiler(types), []  # type: ignore[arg-type]

    def place(x: object, kind: T.DataType) -> object:
        if isinstance(x, tuple):
            return tuple(place(y, kind) for y in x)
        if not isinstance(x, (str, float, int)) or (found := literal_of(x, kind)) is None:
            return x
        values.append(found[0])
        return Param(len(values) - 1, found[1])

    def one(c: object) -> object:
        if not isinstance(c, Condition) or COMPARISONS[c.op] == "is":
            return c
        kind = T.StringType() if COMPARISONS[c.op] == "like" else compiler.type_of(c.unit.left) if c.unit.op == 0 else T.DoubleType()
        return replace(c, low=place(c.low, kind), high=place(c.high, kind))

    parts = {name: tuple(one(c) for c in getattr(q, name)) for name in ("joins", "where", "having")}
    return replace(q, **parts), values


def _params(node: object) -> bool:
    if is_dataclass(node):
        return isinstance(node, Param) or any(_params(getattr(node, f.name)) for f in fields(node))
    return isinstance(node, tuple) and any(map(_params, node))


_SORTED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.DecimalType, T.StringType, *_TIME)


def ranges_of(q: Query, types: Types) -> tuple[list[Condition], list[Condition]] | None:
    """(conditions with parameters, the others) of a template that takes rows of one table whose columns are equal to values and between bounds, at least one of these; None of any other template.

    Conditions stand in a conjunction; nothing is grouped, sorted or limited.
    """
    if len(q.sources) != 1 or q.joins or q.distinct or q.group or q.having or q.order or (q.limit is not None and q.limit >= 0) or TemplateCompiler.aggregates(q):
        return None
    own = [c for c in conditions(q.where) if _params(c)]
    if set(connectors(q.where)) - {"and"} or all(COMPARISONS[c.op] == "=" for c in own):
        return None
    for c in own:
        wanted = {"=": 1, ">": 1, "<": 1, ">=": 1, "<=": 1, "between": 2}.get(COMPARISONS[c.op], 0)
        if not wanted or c.negated or c.unit.op or c.unit.left.agg or c.unit.left.distinct or [isinstance(x, Param) for x in (c.low, c.high)] != [True, wanted > 1]:
            return None
        if not isinstance(Compiler(types).type_of(c.unit.left), _SORTED):  # type: ignore[arg-type]
            return None
    return own, [c for c in conditions(q.where) if not _params(c)]


class TemplateCompiler(Compiler):
    """Compiles a template over ``_p``, a table of statements (stmt, p0, p1, ...)."""

    def literal(self, x: object, kind: T.DataType) -> str | None:
        return f"`_p`.`p{x.index}`" if isinstance(x, Param) else super().literal(x, kind)

    def items(self, q: Query) -> list[str]:
        if [v.left.name for a, v in q.items if not a and not v.left.agg] == ["__all__"] and len(q.items) == 1:
            via = q.items[0][1].left.via  # of a star, only the first column is compared
            own = next((s for s in q.sources if via in (s.alias, s.table[2:-2])), q.sources[0]) if via else q.sources[0]
            table = own.table[2:-2]  # type: ignore[index]
            first = self.catalog.names.tables[table][0]
            self.names_column(table, first)
            return [f"`{own.alias or table}`.`{first}`"]
        return super().items(q)

    def template(self, q: Query, n_params: int) -> tuple[str, list[str], list[str]]:
        """The statement, and the columns of a sort within each ``_s``: keys with directions, and all items.

        Its columns are _s, _c0, ... and, for sort keys that are no items, _k0, ...
        """
        items, keys, extra = self.items(q), [], []
        for i, (v, d) in enumerate(zip(q.order[1], q.directions, strict=True) if q.order else ()):
            text = self.value(v, q)
            if text not in items:
                extra.append(f"{text} AS `_k{i}`")
            keys.append(f"{f'_c{items.index(text)}' if text in items else f'_k{i}'} {d.upper()}")
        if extra and q.distinct:
            raise ValueError("a key outside the select list of DISTINCT")
        shown = ", ".join(["`_p`.`stmt` AS `_s`", *(f"{t} AS `_c{i}`" for i, t in enumerate(items)), *extra])
        text, at = f"SELECT {'DISTINCT ' if q.distinct else ''}{shown} FROM {{_p}} AS `_p`", 0
        for i, s in enumerate(q.sources):
            size = q.on_sizes[i] if i < len(q.on_sizes) else 0
            text += f" {'JOIN' if size else 'CROSS JOIN'} {self.source(s, i)}"
            if size:
                at += at > 0
                text += f" ON {self.conditions(q.joins[at : at + size], q)}"
                at += size
        if q.where:
            text += f" WHERE {self.conditions(q.where, q)}"
        if q.group or self.aggregates(q):
            text += " GROUP BY " + ", ".join(["`_p`.`stmt`", *(f"`_p`.`p{i}`" for i in range(n_params)), *(self.column(c, q) for c in q.group)])
        if q.having:
            text += f" HAVING {self.conditions(q.having, q)}"
        return text, keys, [f"_c{i}" for i in range(len(items))]

    def bounded(self, q: Query, own: list[Condition], others: list[Condition]) -> str:
        """The rows of a template of ``ranges_of`` that meet its other conditions: _c0, ... and, of its own conditions, v0, ..."""
        shown = [*(f"{t} AS `_c{i}`" for i, t in enumerate(self.items(q))), *(f"{self.column(c.unit.left, q)} AS `v{i}`" for i, c in enumerate(own))]
        text = f"SELECT {', '.join(shown)} FROM {self.source(q.sources[0], 0)}"
        return text + (f" WHERE {' AND '.join(self.condition(c, q) for c in others)}" if others else "")

    @staticmethod
    def aggregates(q: Query) -> bool:
        keys = [c for v in (q.order[1] if q.order else ()) for c in (v.left, v.right) if c]
        return any(a or v.left.agg for a, v in q.items) or bool(q.having) or any(c.agg for c in keys)

    def over_nothing(self, q: Query) -> str:
        """A global aggregate's one row when no row meets its conditions."""
        bare = replace(q, joins=(), where=(), having=(), order=(), directions=(), on_sizes=())
        return f"{self.body(bare)} WHERE false"


def is_global(q: Query) -> bool:
    """An aggregate without groups: one row, also over no rows."""
    return not q.group and TemplateCompiler.aggregates(q)


