"""Schemas as rows, and what follows from them: table types, targets, texts.

``Schemas`` holds four small DataFrames of all databases: tables(db_id,
table_idx, table), columns(db_id, col_idx, table_idx, column, type),
fks(db_id, pos, child, parent) and pks(db_id, col_idx).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.text import let, strip

#: How much a match with each type of table counts.
PRIORITIES = {"entity": 1.0, "junction": 0.7, "reference": 0.6}


@dataclass(frozen=True)
class Schemas:
    tables: DataFrame
    columns: DataFrame
    fks: DataFrame
    pks: DataFrame


def from_entries(entries: DataFrame) -> Schemas:
    """Rows from one row for each database, as the schema file has it.

    ``column_names_original`` is an array of [table index, name] pairs, both
    read as strings; foreign_keys an array of [child, parent].
    """
    e = entries.select("db_id", "table_names_original", F.col("column_names_original").cast("array<array<string>>").alias("cols"), "column_types", F.col("primary_keys").cast("array<int>").alias("pk"), F.col("foreign_keys").cast("array<array<int>>").alias("fk"))
    cols = e.select("db_id", "column_types", F.posexplode("cols").alias("col_idx", "c"))
    return Schemas(
        e.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table")),
        cols.select("db_id", "col_idx", F.col("c")[0].cast("int").alias("table_idx"), F.col("c")[1].alias("column"), F.get("column_types", F.col("col_idx")).alias("type")),
        e.select("db_id", F.posexplode("fk").alias("pos", "f")).select("db_id", "pos", F.col("f")[0].alias("child"), F.col("f")[1].alias("parent")),
        e.select("db_id", F.explode("pk").alias("col_idx")),
    )


def from_python(spark: SparkSession, entries: list[dict]) -> Schemas:
    """Rows from parsed entries of the schema file."""
    rows = [(e["db_id"], e["table_names_original"], [[str(t), c] for t, c in e["column_names_original"]], e.get("column_types") or [], list(e.get("primary_keys") or []), [list(k) for k in e.get("foreign_keys") or []]) for e in entries]
    ddl = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
    return from_entries(spark.createDataFrame(rows, ddl))


def is_id_column(name: Column) -> Column:
    return strip(F.lower(name)).rlike(r"^id$|_id$")


def is_internal_table(name: Column) -> Column:
    return strip(F.lower(name)).startswith("sqlite_")


def looks_like_code(name: Column) -> Column:
    return strip(F.lower(name)).rlike(r"^id$|_id$|code")


def looks_like_description(name: Column) -> Column:
    return strip(F.lower(name)).rlike(r"description|_desc$|_name$|^name$")


def priority(table_type: Column) -> Column:
    out = F
    for k, v in PRIORITIES.items():
        out = out.when(table_type == k, v)
    return out.otherwise(1.0)


def table_type(table: Column, columns: Column, fk_columns: Column) -> Column:
    """reference, junction or entity; ``columns`` and ``fk_columns`` are name arrays."""
    name, fks = strip(F.lower(table)), F.array_distinct(F.filter(fk_columns, lambda c: c.isNotNull() & (c != "")))
    a, b = F.get(columns, 0), F.get(columns, 1)
    pair = (looks_like_code(a) & looks_like_description(b)) | (looks_like_code(b) & looks_like_description(a))
    known = F.filter(columns, lambda c: c.isNotNull())
    #: At most one different column is no key, and only once: sets, as a test of each column against the keys would be their product.
    lone = let(F.array_except(known, fks), lambda rest: F.when(F.size(rest) <= 1, let(F.get(rest, F.lit(0)), lambda one: F.size(F.filter(columns, lambda c: c == one)) <= 1)).otherwise(False))
    return (
        F.when(name.rlike(r"^ref_|_types$|_codes$"), "reference")
        .when((F.size(columns) == 2) & (F.size(fks) == 0) & pair, "reference")
        .when((F.size(fks) >= 2) & lone, "junction")
        .otherwise("entity")
    )


def _ordered(entry: Column, place: str, field: str) -> Column:
    """Array of ``field`` of collected structs, by their ``place``."""
    return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x[field])


def foreign_keys_by_table(s: Schemas) -> DataFrame:
    """(db_id, table_idx, fks): each table's keys in file order; a table without any has []."""
    c, t = s.columns, s.tables
    child = c.select("db_id", F.col("col_idx").alias("child"), F.col("table_idx").alias("child_table"), F.col("column").alias("fk_column"))
    parent = c.select("db_id", F.col("col_idx").alias("parent"), F.col("table_idx").alias("parent_table"), F.col("column").alias("ref_column"))
    named = t.select("db_id", F.col("table_idx").alias("parent_table"), F.col("table").alias("ref_table"))
    rows = s.fks.join(child, ["db_id", "child"]).join(parent, ["db_id", "parent"]).filter("child_table >= 0 AND parent_table >= 0").join(named, ["db_id", "parent_table"])
    by = rows.groupBy("db_id", F.col("child_table").alias("table_idx")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("fk_column").alias("column"), "ref_table", "ref_column"))).alias("f"))
    joined = t.select("db_id", "table_idx").join(by, ["db_id", "table_idx"], "left")
    empty = F.array().cast("array<struct<column: string, ref_table: string, ref_column: string>>")
    return joined.select("db_id", "table_idx", F.coalesce(F.transform("f", lambda x: F.struct(x["column"].alias("column"), x["ref_table"].alias("ref_table"), x["ref_column"].alias("ref_column"))), empty).alias("fks"))


def table_columns(s: Schemas) -> DataFrame:
    """(db_id, table_idx, table, columns): every table, columns in file order."""
    by = s.columns.filter("table_idx >= 0").groupBy("db_id", "table_idx").agg(_ordered(F.struct("col_idx", "column"), "col_idx", "column").alias("c"))
    return s.tables.join(by, ["db_id", "table_idx"], "left").select("db_id", "table_idx", "table", F.coalesce("c", F.array().cast("array<string>")).alias("columns"))


def classified(s: Schemas) -> DataFrame:
    """(db_id, table_idx, table, columns, fks, table_type) of all tables."""
    both = table_columns(s).join(foreign_keys_by_table(s), ["db_id", "table_idx"])
    return both.withColumn("table_type", table_type(F.col("table"), F.col("columns"), F.col("fks.column")))


def schema_names(s: Schemas) -> DataFrame:
    """(db_id, names): lower-cased names of tables that are not internal, and of their columns."""
    tables = s.tables.filter(~is_internal_table(F.col("table")))
    columns = s.columns.join(tables.select("db_id", "table_idx"), ["db_id", "table_idx"], "left_semi")
    every = tables.select("db_id", F.lower("table").alias("n")).union(columns.select("db_id", F.lower("column").alias("n")))
    return every.groupBy("db_id").agg(F.sort_array(F.collect_set("n")).alias("names"))


def table_texts(s: Schemas) -> DataFrame:
    """(db_id, table_idx, table, text): ``T: a, b`` without id columns."""
    t = table_columns(s).filter(~is_internal_table(F.col("table")))
    plain = F.filter("columns", lambda c: ~is_id_column(c))
    return t.select("db_id", "table_idx", "table", F.when(F.size(plain) > 0, F.concat("table", F.lit(": "), F.array_join(plain, ", "))).otherwise(F.col("table")).alias("text"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Targets with ``target_idx``, their place among the database's: tables, each before its columns."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("db_id").orderBy("table_pos", "col_pos")) - 1
    return rows.select("db_id", place.alias("target_idx"), "text", "table", "column", "table_type")


def targets(s: Schemas) -> DataFrame:
    """(db_id, target_idx, text, table, column, table_type) from identifiers.

    Id-like columns that are primary or foreign keys are no targets.
    """
    t = classified(s).filter(~is_internal_table(F.col("table"))).select("db_id", "table_idx", "table", "table_type")
    keys = s.pks.select("db_id", "col_idx").union(s.fks.join(s.columns.filter("table_idx >= 0").select("db_id", F.col("col_idx").alias("child")), ["db_id", "child"], "left_semi").select("db_id", F.col("child").alias("col_idx"))).distinct().withColumn("key", F.lit(True))
    cols = s.columns.join(t, ["db_id", "table_idx"]).join(keys, ["db_id", "col_idx"], "left").filter(~(is_id_column(F.col("column")) & F.coalesce("key", F.lit(False))))
    whole = t.select("db_id", F.col("table_idx").alias("table_pos"), F.lit(-1).alias("col_pos"), F.col("table").alias("text"), "table", F.lit(None).cast("string").alias("column"), "table_type")
    each = cols.select("db_id", F.col("table_idx").alias("table_pos"), F.col("col_idx").alias("col_pos"), F.concat_ws(" ", "table", "column").alias("text"), "table", "column", "table_type")
    return _numbered(whole.unionByName(each))


def rich_targets(descriptions: DataFrame, s: Schemas | None = None) -> DataFrame:
    """Targets with texts from descriptions; databases without any use ``targets``.

    ``descriptions`` is (db_id, table_pos, table, description, col_pos, column,
    col_description), one row for each described column, and one with a null
    column for a table without columns.  Columns that are only keys are left out.
    """
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    d = descriptions.filter(~is_internal_table(F.col("table")))
    per = d.groupBy("db_id", "table_pos", "table").agg(F.first("description").alias("description"), F.transform(F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("col_pos", "column")))), lambda x: x["column"]).alias("columns"))
    if s is not None:
        known = s.tables.join(foreign_keys_by_table(s), ["db_id", "table_idx"]).select("db_id", "table", F.col("fks.column").alias("fk"))
        per = per.join(known, ["db_id", "table"], "left").withColumn("fk", F.coalesce("fk", F.array().cast("array<string>")))
    else:
        per = per.withColumn("fk", F.array().cast("array<string>"))
    per = per.withColumn("table_type", table_type(F.col("table"), F.col("columns"), F.col("fk")))
    whole = per.select("db_id", "table_pos", F.lit(-1).alias("col_pos"), F.concat_ws(" ", said("table"), said("description")).alias("text"), "table", F.lit(None).cast("string").alias("column"), "table_type")
    text = strip(F.lower(F.coalesce("col_description", F.lit(""))))
    cols = d.filter(F.col("column").isNotNull() & ~(text.startswith("pk.") & ~text.contains("fk")))
    each = cols.join(per.select("db_id", "table_pos", "table_type"), ["db_id", "table_pos"]).select("db_id", "table_pos", "col_pos", F.concat_ws(" ", said("table"), said("column"), said("col_description")).alias("text"), "table", "column", "table_type")
    rich = _numbered(whole.unionByName(each))
    if s is None:
        return rich
    return rich.unionByName(targets(s).join(descriptions.select("db_id").distinct(), "db_id", "left_anti"))


def schema_texts(s: Schemas) -> DataFrame:
    """(db_id, schema_text): tables with typed columns, then foreign keys."""
    t = s.tables.filter(~is_internal_table(F.col("table")))
    cols = s.columns.filter("table_idx >= 0").groupBy("db_id", "table_idx").agg(_ordered(F.struct("col_idx", F.concat(F.lit("  - "), "column", F.lit(" ("), "type", F.lit(")")).alias("line")), "col_idx", "line").alias("lines"))
    blocks = t.join(cols, ["db_id", "table_idx"], "left").select("db_id", "table_idx", F.concat(F.array(F.concat(F.lit("Table: "), "table")), F.coalesce("lines", F.array().cast("array<string>")), F.array(F.lit(""))).alias("lines"))
    body = blocks.groupBy("db_id").agg(F.flatten(_ordered(F.struct("table_idx", "lines"), "table_idx", "lines")).alias("body"))
    end = lambda side: s.columns.join(s.tables, ["db_id", "table_idx"]).select("db_id", F.col("col_idx").alias(side), F.concat_ws(".", "table", "column").alias(f"{side}_name"), is_internal_table(F.col("table")).alias(f"{side}_internal"))
    fk = s.fks.join(end("child"), ["db_id", "child"]).join(end("parent"), ["db_id", "parent"]).filter("NOT child_internal AND NOT parent_internal")
    fk = fk.groupBy("db_id").agg(_ordered(F.struct("pos", F.concat(F.lit("  - "), "child_name", F.lit(" -> "), "parent_name").alias("line")), "pos", "line").alias("keys"))
    every = s.tables.select("db_id").distinct().join(body, "db_id", "left").join(fk, "db_id", "left")
    none = F.array().cast("array<string>")
    keys = F.when(F.size("keys") > 0, F.concat(F.array(F.lit("Foreign Keys:")), F.col("keys"))).otherwise(none)
    return every.select("db_id", F.array_join(F.concat(F.array(F.concat(F.lit("Database: "), "db_id"), F.lit("")), F.coalesce("body", none), keys), "\n").alias("schema_text"))
