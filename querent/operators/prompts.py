"""Prompts: schema, descriptions, hints and question as one text, and chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.text import strip

#: The wording of prompts.
OPENING = "You are an expert SQL developer. Given a database schema and a natural language question, generate a valid SQL query.\n\n"
CLOSING = "\n\nGenerate only the SQL query without any explanation.\nThe query should be syntactically correct and answer the question."
HINTS_HEAD = "\nThe following Vietnamese terms map to these schema items:\n"
SYSTEM = "You are a helpful SQL expert."


def description_section(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(t != "", F.concat(t, F.lit("\n\n"))).otherwise("")


def hint_lines(hints: Column) -> Column:
    def line(h: Column) -> Column:
        on_column = F.coalesce(h["column"], F.lit("")) != ""
        target = F.when(on_column, F.concat(h["table"], F.lit("."), h["column"])).otherwise(F.concat(F.lit("table: "), h["table"]))
        return F.concat(F.lit('  - "'), h["vi_noun"], F.lit('" → '), target)

    return F.array_join(F.transform(hints, line), "\n")


def prompt(question: Column, schema_text: Column, description: Column | None = None, hints: Column | None = None) -> Column:
    """Description, schema, hints, question, in this order.

    Without hints (null or an empty array) the text is that of the base prompt.
    """
    head = F.concat(F.lit(OPENING), description_section(description if description is not None else F.lit("")), schema_text)
    shown = F.lit("\n")
    if hints is not None:
        shown = F.when(F.size(hints) > 0, F.concat(F.lit("\n" + HINTS_HEAD), hint_lines(hints), F.lit("\n"))).otherwise("\n")
    return F.concat(head, shown, F.lit("\nQuestion: "), question, F.lit(CLOSING))


def messages(user: Column, system: str = SYSTEM) -> Column:
    """array<struct<role, content>> of the system and the user turn."""
    pair = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(pair("system", F.lit(system)), pair("user", user))


def build_prompts(examples: DataFrame, schema_texts: DataFrame, descriptions: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """(example_idx, db_id, prompt, messages) of examples(example_idx, db_id, question).

    Joined with (db_id, schema_text), (db_id, description_text) and
    (example_idx, hints).  A database without a schema is an error.
    """
    e = examples.join(schema_texts, "db_id", "left")
    text = F.coalesce("schema_text", F.raise_error(F.concat(F.lit("Database '"), "db_id", F.lit("' not found in tables.json"))))
    if descriptions is not None:
        e = e.join(descriptions, "db_id", "left")
    if hints is not None:
        e = e.join(hints.select("example_idx", "hints"), "example_idx", "left")
    body = prompt(F.col("question"), text, F.col("description_text") if descriptions is not None else None, F.col("hints") if hints is not None else None)
    return e.select("example_idx", "db_id", body.alias("prompt")).withColumn("messages", messages(F.col("prompt")))
