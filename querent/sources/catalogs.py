"""Catalogs for execution, and schema entries read off them."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession

from querent.plans.compiler import Catalog


def schema_of(catalog: Catalog) -> dict[str, list[str]]:
    """Tables and columns, lower-cased."""
    return {t: list(c) for t, c in catalog.names.tables.items()}


def schema_of_json(entries: list[dict]) -> dict[str, list[str]]:
    """Tables and columns of a list of {table, col_data: [{column_name}]}."""
    return {e["table"].lower(): [c["column_name"].lower() for c in e["col_data"]] for e in entries}


def of_database(spark: SparkSession, database: str) -> Catalog:
    """All tables of a database in Spark's catalog; temporary views belong to none."""
    return Catalog({t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database) if not t.isTemporary})


def _opened(content: bytes) -> sqlite3.Connection:
    """A database file as a connection; one in write-ahead mode is marked as plain, which its bytes are."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content[:18] + b"\1\1" + content[20:])
    con.text_factory = lambda b: b.decode("utf-8", "ignore")
    return con


def quoted_name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def kind_of(con: sqlite3.Connection, table: str, column: str, declared: str) -> str:
    """The type that holds all values of a column; without any, what its declared type suggests."""
    found = {r[0] for r in con.execute(f"SELECT DISTINCT typeof({quoted_name(column)}) FROM {quoted_name(table)}")} - {"null"}
    if not found:
        d = declared.upper()
        return "bigint" if "INT" in d else "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"
    return "bigint" if found == {"integer"} else "double" if found <= {"integer", "real"} else "string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            con = _opened(content)
            for (table,) in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite~_%' ESCAPE '~' ORDER BY rowid").fetchall():
                columns = [(r[1], kind_of(con, table, r[1], r[2] or "")) for r in con.execute(f"PRAGMA table_info({quoted_name(table)})").fetchall()]
                yield pa.RecordBatch.from_arrays([pa.array([table]), pa.array([[c for c, _ in columns]]), pa.array([[k for _, k in columns]])], ["name", "columns", "kinds"])


def _stored(batches: Iterator[pa.RecordBatch], table: str, columns: list[str], kinds: list[str], size: int) -> Iterator[pa.RecordBatch]:
    to = {"bigint": (int, pa.int64()), "double": (float, pa.float64()), "string": (lambda v: v.decode("utf-8", "ignore") if isinstance(v, bytes) else str(v), pa.string())}
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = _opened(content).execute(f"SELECT {', '.join(map(quoted_name, columns))} FROM {quoted_name(table)}")
            while part := rows.fetchmany(size):
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else to[k][0](v) for v in c], to[k][1]) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], columns)


def of_sqlite(spark: SparkSession, path: str, size: int = 10_000) -> Catalog:
    """All tables of a SQLite file, wherever Spark can read it.

    The file is read as bytes and opened in the task, so no driver for it and no
    local copy is needed; only table and column names go to the driver.  A file
    is one task, and at most 2 GB.  A column of mixed types is text.
    """
    file = spark.read.format("binaryFile").load(path).select("content")
    found = file.mapInArrow(_described, "name string, columns array<string>, kinds array<string>").collect()
    ddl = lambda t: ", ".join(f"`{c.replace('`', '``')}` {k}" for c, k in zip(t.columns, t.kinds, strict=True))
    return Catalog({t.name: file.mapInArrow(partial(_stored, table=t.name, columns=list(t.columns), kinds=list(t.kinds), size=size), ddl(t)) for t in found})


def entry_of(catalog: Catalog, db_id: str, keys: list[tuple[str, str]] = ()) -> dict:
    """A schema entry for the catalog; keys are (child, parent) as ``table.column``."""
    tables = list(catalog.names.tables)
    columns, at = [[-1, "*"]], {}
    types = ["text"]
    for i, t in enumerate(tables):
        for c in catalog.names.tables[t]:
            at[f"{t}.{c}"] = len(columns)
            columns.append([i, c])
            types.append(catalog.types[t, c].simpleString())
    return {"db_id": db_id, "table_names_original": tables, "column_names_original": columns, "column_types": types, "primary_keys": [], "foreign_keys": [[at[a], at[b]] for a, b in keys]}
