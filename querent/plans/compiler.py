"""From the IR to a DataFrame, with SQLite's semantics on Catalyst.

The IR becomes one Spark SQL statement over the catalog's DataFrames, so
Catalyst pushes filters, prunes columns, decorrelates subqueries and picks
joins.  What differs between the engines is written out: integer division
truncates and division by zero is null, LIKE ignores case, literals take the
column's type, a scalar subquery gives its first row, bare columns beside
aggregates take any row (the extreme one beside a lone max or min).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from querent.plans.ir import AGGREGATES, ARITHMETIC, COMPARISONS, Column, Condition, Query, Source, Value
from querent.plans.parser import Names, parse

_NUMBER = (T.NumericType, T.BooleanType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


class Catalog:
    """Named DataFrames, with their columns and types."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = {k.lower(): v for k, v in tables.items()}
        self.types = {(t, f.name.lower()): f.dataType for t, df in self.tables.items() for f in df.schema}
        self.names = Names({t: df.columns for t, df in self.tables.items()})

    def frame(self, table: str, columns: set[str] | None) -> DataFrame:
        """A table for a statement that names these columns (None: all); readers that cannot be told by Catalyst narrow it here."""
        return self.tables[table]

    @staticmethod
    def of_folder(spark: SparkSession, path: str, names: list[str]) -> Catalog:
        return Catalog({n: spark.read.parquet(f"{path}/{n}.parquet") for n in names})


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "{{").replace("}", "}}") + "'"


class Compiler:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        #: Columns named of each table used; None for all.
        self.used: dict[str, set[str] | None] = {}
        #: The table of each name in braces: a table has one for every place where it stands.
        self.places: dict[str, str] = {}

    def frames(self) -> dict[str, DataFrame]:
        return {place: self.catalog.frame(t, self.used[t]) for place, t in self.places.items()}

    def names_column(self, table: str, column: str | None) -> None:
        """Note a column of a table, or with None all of them."""
        if column is None:
            self.used[table] = None
        elif (known := self.used.setdefault(table, set())) is not None:
            known.add(column)

    # -- names and types

    def type_of(self, c: Column):
        if c.name == "__all__" or c.agg == AGGREGATES.index("count"):
            return T.LongType()
        own = self.catalog.types.get(tuple(c.name.strip("_").split(".", 1)) if c.name.count(".") else ("", ""))
        if own is None:
            table, _, col = c.name[2:-2].partition(".")
            own = self.catalog.types.get((table, col), T.StringType())
        return T.DoubleType() if c.agg == AGGREGATES.index("avg") else own

    def column(self, c: Column, q: Query) -> str:
        if c.name == "__all__":
            body = f"`{c.via}`.*" if c.via else "*"
            if not c.agg:
                for s in q.sources:
                    if s.table:
                        self.names_column(s.table[2:-2], None)
        else:
            table, _, col = c.name[2:-2].partition(".")
            self.names_column(table, col)
            via = c.via
            if via is None:
                own = next((s for s in q.sources if s.table == f"__{table}__"), None)
                via = (own.alias or table) if own else table
            body = f"`{via}`.`{col}`"
        return self.aggregate(c.agg, body, bool(c.distinct)) if c.agg else body

    @staticmethod
    def aggregate(agg: int, body: str, distinct: bool = False) -> str:
        return f"{AGGREGATES[agg]}({'DISTINCT ' if distinct else ''}{body})"

    def value(self, v: Value, q: Query) -> str:
        left = self.column(v.left, q)
        if v.op == 0 or v.right is None:
            return left
        right, op = self.column(v.right, q), ARITHMETIC[v.op]
        if op == "/":
            whole = all(isinstance(self.type_of(c), _WHOLE) for c in (v.left, v.right))
            return f"({left} {'div' if whole else '/'} nullif({right}, 0))"
        return f"({left} {op} {right})"

    # -- conditions

    def literal(self, x: object, kind) -> str | None:
        """The literal in the column's type; None when a text is no such value."""
        if isinstance(x, str):
            text = x.strip('"')
            if isinstance(kind, _NUMBER):
                try:
                    x = float(text)
                except ValueError:
                    return None
            elif isinstance(kind, _TIME):
                return f"try_cast({_quoted(text)} AS TIMESTAMP_NTZ)"
            else:
                return _quoted(text)
        number = str(int(x)) if float(x).is_integer() and abs(x) < 2**53 else f"{x!r}D"  # type: ignore[arg-type]
        return number if isinstance(kind, _NUMBER) else _quoted(number.rstrip("D"))

    def condition(self, c: Condition, q: Query) -> str:
        op, unit = COMPARISONS[c.op], self.value(c.unit, q)
        kind = self.type_of(c.unit.left) if c.unit.op == 0 else T.DoubleType()
        no = "NOT " if c.negated else ""
        if op == "is":
            return f"({unit} IS {no}NULL)"
        if op == "in":
            if isinstance(c.low, Query):
                return f"({unit} {no}IN ({self.query(c.low)}))"
            many = c.low if isinstance(c.low, tuple) else (c.low,)
            shown = [s for x in many if (s := self.operand(x, q, kind)) is not None]
            return f"({unit} {no}IN ({', '.join(shown) or 'NULL'}))"
        low = self.operand(c.low, q, kind)
        if op == "like":
            text = unit if isinstance(kind, T.StringType) else f"CAST({unit} AS STRING)"
            return f"({text} {no}ILIKE {self.operand(c.low, q, T.StringType())})"
        if op == "between":
            high = self.operand(c.high, q, kind)
            if low is None or high is None:
                low, high = low or "double('Infinity')", high or "double('Infinity')"
            return f"({unit} {no}BETWEEN {low} AND {high})"
        if low is None:  # a number beside a text that is none: texts are greater
            holds = op in ("!=", "<", "<=")
            return f"({no}({unit} IS NOT NULL AND {str(holds).lower()}))"
        return f"({no}({unit} {op} {low}))"

    def operand(self, x: object, q: Query, kind) -> str | None:
        if isinstance(x, Query):
            inner = x if x.limit is not None or self.single(x) else Query(**{**x.__dict__, "limit": 1})
            return f"({self.query(inner)})"
        if isinstance(x, Column):
            return self.column(x, q)
        if isinstance(x, Value):
            return self.value(x, q)
        return self.literal(x, kind)

    @staticmethod
    def single(q: Query) -> bool:
        """A global aggregate: one row for certain."""
        return not q.group and not q.set_op and all(a or v.left.agg for a, v in q.items)

    def conditions(self, flat: tuple, q: Query) -> str:
        return " ".join(x.upper() if isinstance(x, str) else self.condition(x, q) for x in flat)

    # -- queries

    def source(self, s: Source, i: int) -> str:
        if s.query is not None:
            return f"({self.query(s.query)}) AS `_derived{i}`"
        name = s.table[2:-2]  # type: ignore[index]
        self.used.setdefault(name, set())
        place = f"{name}__{len(self.places)}"
        self.places[place] = name
        return f"{{{place}}} AS `{s.alias or name}`"

    def items(self, q: Query) -> list[str]:
        grouped = bool(q.group) or any(a or v.left.agg for a, v in q.items) or bool(q.having)
        own = {g.name for g in q.group}
        lone = [(a, v) for a, v in q.items if a]
        pick = AGGREGATES[lone[0][0]] if len(lone) == 1 else ""
        out = []
        for agg, v in q.items:
            text = self.value(v, q)
            if agg:
                distinct = bool(v.left.distinct)
                text = f"any_value({text})" if agg == 0 else self.aggregate(agg, text, distinct)
            elif grouped and not v.left.agg and v.left.name != "__all__" and not {c.name for c in (v.left, v.right) if c} <= own:
                text = f"{pick}_by({text}, {self.value(lone[0][1], q)})" if pick in ("max", "min") else f"any_value({text})"
            out.append(text)
        return out

    def body(self, q: Query) -> str:
        """Without ORDER BY, LIMIT and set operations."""
        items = [f"{t} AS `_c{i}`" if not t.endswith("*") else t for i, t in enumerate(self.items(q))]
        text = f"SELECT {'DISTINCT ' if q.distinct else ''}{', '.join(items)} FROM "
        at = 0
        for i, s in enumerate(q.sources):
            size = q.on_sizes[i] if i < len(q.on_sizes) else 0
            shown = self.source(s, i)
            if i:
                text += " JOIN " if size else " CROSS JOIN "
            text += shown
            if size:
                at += at > 0  # the connector between two ON clauses
                on = self.conditions(q.joins[at : at + size], q)
                at += size
                text += f" ON {on}"
        if q.where:
            text += f" WHERE {self.conditions(q.where, q)}"
        if q.group:
            text += f" GROUP BY {', '.join(self.column(c, q) for c in q.group)}"
        if q.having:
            text += f" HAVING {self.conditions(q.having, q)}"
        return text

    def keys(self, q: Query, last: Query, compound: bool) -> str:
        """Sort keys; by place in the select list where the key is an item of it."""
        out = []
        items = self.items(last)
        for v, d in zip(last.order[1], last.directions, strict=True):
            text = self.value(v, last)
            place = items.index(text) if text in items else -1
            if compound and place < 0:
                place = 0
            out.append(f"{place + 1 if place >= 0 else text} {d.upper()}")
        return ", ".join(out)

    def query(self, q: Query) -> str:
        parts, ops, node = [q], [], q
        while node.set_op:  # the IR nests to the right; execution goes from the left
            ops.append(node.set_op[0])
            node = node.set_op[1]
            parts.append(node)
        last = parts[-1]
        text = self.body(q)
        for op, p in zip(ops, parts[1:], strict=True):
            text = f"({text}) {op.upper()} ({self.body(p)})"
        if last.order:
            text += f" ORDER BY {self.keys(q, last, bool(ops))}"
        if last.limit is not None:
            text += f" LIMIT {max(0, last.limit)}" if last.limit >= 0 else ""
        return text


def to_spark_sql(query: Query, catalog: Catalog) -> tuple[str, dict[str, DataFrame]]:
    """The statement and the DataFrames that its braces name."""
    c = Compiler(catalog)
    text = c.query(query)
    return text, c.frames()


def compile_query(spark: SparkSession, sql: str, catalog: Catalog, columns: list[str] | None = None) -> DataFrame:
    """The DataFrame of a text in the subset; ``columns`` renames its columns."""
    text, frames = to_spark_sql(parse(sql, catalog.names, strict=False), catalog)
    out = spark.sql(text, **frames)
    return out.toDF(*columns) if columns else out
