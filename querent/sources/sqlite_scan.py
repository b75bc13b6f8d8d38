"""A Spark data source for tables of SQLite files in a folder that all executors see.

A table is read by ranges of its row ids, each in a task of its own, straight
from the file's pages; filters go into the statement of each range, and the
schema asked for says which columns are read.  Files in other stores go through
``querent.sources.catalogs.of_sqlite``, which ships them as bytes.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not

from querent.plans.compiler import Catalog
from querent.sources.catalogs import kind_of, quoted_name

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
_MAKE = {"bigint": int, "double": float, "string": lambda v: v.decode("utf-8", "ignore") if isinstance(v, bytes) else str(v)}


def opened(path: str) -> sqlite3.Connection:
    """The file, read only."""
    con = sqlite3.connect(f"file:{quote(path.removeprefix('file://').removeprefix('file:'))}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "ignore")
    return con


@dataclass
class Range(InputPartition):
    """Row ids from low to high; all rows where a table has none."""

    low: int | None
    high: int | None


_COMPARE = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def condition(f: Filter, kinds: Mapping[str, str]) -> tuple[str, list] | None:
    """A filter as SQL with its values; None for what SQLite would compare in another way."""
    if isinstance(f, Not):
        inner = condition(f.child, kinds)
        return inner and (f"NOT ({inner[0]})", inner[1])
    path = getattr(f, "attribute", ())
    if len(path) != 1 or path[0] not in kinds:
        return None
    name, kind = quoted_name(path[0]), kinds[path[0]]
    if isinstance(f, IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in _COMPARE else None
    wanted = (str,) if kind == "text" else (int, float)
    if values is None or kind == "mixed" or any(isinstance(v, bool) or not isinstance(v, wanted) for v in values):
        return None
    name += " COLLATE BINARY" if kind == "text" else ""
    return (f"{name} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{name} {_COMPARE[type(f)]} ?"), values


class SqliteReader(DataSourceReader):
    """Ranges of one table, with the filters that it takes over."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))
        self.columns = [f.name for f in schema]
        self.kinds = [f.dataType.simpleString() for f in schema]
        con = opened(self.path)
        #: Only of columns whose values are all of one storage class does SQLite compare as Spark does.
        self.stored = {}
        for c, k in zip(self.columns, self.kinds, strict=True):
            found = {r[0] for r in con.execute(f"SELECT DISTINCT typeof({quoted_name(c)}) FROM {quoted_name(self.table)}")} - {"null"}
            self.stored[c] = "number" if k != "string" else "text" if found <= {"text"} else "mixed"
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters go to the statement; those on texts are tested again, as bytes that are no UTF-8 are left out on reading."""
        for f in filters:
            made = condition(f, self.stored)
            if made:
                self.where.append(made)
            if made is None or any(isinstance(v, str) for v in made[1]):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        try:
            low, high = opened(self.path).execute(f"SELECT min(rowid), max(rowid) FROM {quoted_name(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table without row ids
            return [Range(None, None)]
        if low is None:
            return [Range(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests = [t for t, _ in self.where] + (["rowid BETWEEN ? AND ?"] if partition.low is not None else [])
        values = [v for _, vs in self.where for v in vs] + ([partition.low, partition.high] if partition.low is not None else [])
        shown = ", ".join(map(quoted_name, self.columns))
        rows = opened(self.path).execute(f"SELECT {shown} FROM {quoted_name(self.table)}" + (f" WHERE {' AND '.join(f'({t})' for t in tests)}" if tests else ""), values)
        while part := rows.fetchmany(10_000):
            yield pa.RecordBatch.from_arrays([pa.array([None if v is None else _MAKE[k](v) for v in c], _ARROW[k]) for c, k in zip(zip(*part, strict=True), self.kinds, strict=True)], self.columns)


class SqliteSource(DataSource):
    """``format("sqlite_table")`` with options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        con, table = opened(self.options["path"]), self.options["table"]
        to = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
        return T.StructType([T.StructField(r[1], to[kind_of(con, table, r[1], r[2] or "")]) for r in con.execute(f"PRAGMA table_info({quoted_name(table)})").fetchall()])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


class Loaded(Mapping):
    """DataFrames by name, made anew each time: Spark keeps the filters pushed to a Python source with what ``load`` made, so two scans may not share it."""

    def __init__(self, load: Callable[[str], DataFrameReader], names: list[str]):
        self.load, self.names = load, {n.lower(): n for n in names}

    def __getitem__(self, name: str) -> DataFrame:
        return self.load(self.names[name]).load()

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class SqliteCatalog(Catalog):
    """Tables of a file; a statement's frames have only the columns that it names."""

    def __init__(self, spark: SparkSession, path: str, partitions: int):
        def load(table: str) -> DataFrameReader:
            return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions)

        names = [r[0] for r in opened(path).execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite~_%' ESCAPE '~' ORDER BY rowid")]
        super().__init__({n: load(n).load() for n in names})
        self.schemas = {t: df.schema for t, df in self.tables.items()}
        self.tables = Loaded(load, names)

    def frame(self, table: str, columns: set[str] | None) -> DataFrame:
        if columns is None:
            return self.tables[table]
        kept = [f for f in self.schemas[table] if f.name.lower() in columns] or self.schemas[table].fields[:1]
        return self.tables.load(self.tables.names[table]).schema(T.StructType(kept)).load()


def of_shared_sqlite(spark: SparkSession, path: str, partitions: int = 8) -> SqliteCatalog:
    """All tables of a SQLite file that the driver and all executors can open, of any size.

    Each table is scanned in up to ``partitions`` ranges of row ids.  Turns on
    filter push-down to Python data sources in the session.
    """
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return SqliteCatalog(spark, path, partitions)
