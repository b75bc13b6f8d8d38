"""Structural matching of many pairs as joins and one aggregate.

Statements that differ in literals only have one form, which SQL functions make;
each different form is parsed once, wherever it occurs, and a statement is parsed
by itself only where its literals matter.  What is parsed is hashed in a canonical
shape, in which what the measure ignores is gone and what it compares as a
multiset is sorted: a pair matches exactly where both fingerprints are equal.
Its clauses become arrays of texts in which repeats are numbered,
so the shared part of two multisets is the intersection of two sets.  Pairs of
equal clauses are counted before they are scored, and levels are grouping sets.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators.exact import PARTS, Databases, hardness, keywords, normalise
from querent.plans.ir import EMPTY, Query, conditions, connectors, to_json
from querent.plans.parser import Names, ParseError, parse, tokenize
from querent.sources.files import stored


def numbered(texts: list[str]) -> list[str]:
    """Texts with the number of each among its equals: multisets as sets."""
    seen: Counter[str] = Counter()
    out = []
    for t in texts:
        out.append(f"{seen[t]}:{t}")
        seen[t] += 1
    return out


def _group(q: Query) -> list[str]:
    """GROUP BY in its order with HAVING, as one element where there is a GROUP BY."""
    return [json.dumps([[c.name for c in q.group], to_json(q.having)])] if q.group else []


def _order(q: Query) -> list[str]:
    return [json.dumps([to_json(q.order), q.limit is None])] if q.order else []


def clauses(q: Query) -> dict[str, list[str]]:
    """The elements of each part of a normalised query, repeats numbered."""
    bare = [n.split(".")[1] if "." in n else n for n in (c.name for c in q.group)]
    return {
        "select": numbered([to_json(i) for i in q.items]),
        "select(no AGG)": numbered([to_json(v) for _, v in q.items]),
        "where": numbered([to_json(c) for c in conditions(q.where)]),
        "where(no OP)": numbered([to_json(c.unit) for c in conditions(q.where)]),
        "group(no Having)": numbered(bare),
        "group": _group(q),
        "order": _order(q),
        "and/or": sorted(set(connectors(q.where))),
        "IUEN": [f"{q.set_op[0]}:{fingerprint(q.set_op[1])}"] if q.set_op else [],
        "keywords": sorted(keywords(q)),
    }


def fingerprint(q: Query) -> str:
    """Equal for two normalised queries exactly where the measure calls them a match."""
    parts = {k: sorted(v) for k, v in clauses(q).items()}
    return sha256(json.dumps([parts, sorted(to_json(s) for s in q.sources)], sort_keys=True).encode()).hexdigest()


_CLAUSES = pa.list_(pa.list_(pa.string()))
_STATEMENTS = pa.schema([("db_id", pa.string()), ("sql", pa.string()), ("fingerprint", pa.string()), ("level", pa.string()), ("error", pa.string()), ("clauses", _CLAUSES), ("is_form", pa.bool_())])
_STATEMENTS_DDL = "db_id string, sql string, fingerprint string, level string, error string, clauses array<array<string>>, is_form boolean"

#: What stands for a text, a whole number and another number in a form, and what stands there when a form is tried again.
FILLED = {'"value"': '"other"', "271828182845904": "314159265358979", "271828.182845904": "314159.265358979"}
_TEXT, _WHOLE, _OTHER = FILLED
_NUMBER = r"(?<![^\s();<>])-?\d{1,15}%s(?![^\s();<>])"


def form(sql: Column) -> Column:
    """The statement with fillings in place of literals: quoted spans, and numbers that are a token of their own.

    Whole numbers have their own filling, as LIMIT takes no others.  Equal
    statements have equal forms, and a form is its own form.
    """
    quoted = F.regexp_replace(F.translate(sql, "'", '"'), '"[^"]*"', _TEXT)
    whole = F.regexp_replace(quoted, _NUMBER % "", _WHOLE)
    return F.regexp_replace(whole, _NUMBER % r"(?:\.\d{1,15}(?:[eE]-?\d{1,3})?|[eE]-?\d{1,3})", _OTHER)


def _judged(sql: str, names: Names, keys: dict[str, str]) -> tuple:
    """(fingerprint, level, error, clauses) of a text."""
    try:
        q, error = parse(sql, names), None
        level = hardness(q)
    except (ParseError, RecursionError) as e:
        q, error, level = EMPTY, f"{type(e).__name__}: {e}", None
    q = normalise(q, names, keys)
    own = clauses(q)
    return fingerprint(q), level, error, [own[p] for p in PARTS]


def _is_free(text: str, judged: tuple, names: Names, keys: dict[str, str]) -> bool:
    """Whether all statements of a form are judged alike.

    The parser only asks of a literal which kind it is, and passes it on, into
    the query or a message; where either still shows in the result, another
    filling changes it.  Only an alias is compared with other tokens.
    """
    other = text
    for a, b in FILLED.items():
        other = other.replace(a, b)
    if other == text:
        return True
    if judged != _judged(other, names, keys):
        return False
    try:
        tokens = tokenize(text)
    except ParseError:
        return True
    return not any(t == "as" and not FILLED.keys().isdisjoint(tokens[max(0, i - 1) : i + 2]) for i, t in enumerate(tokens))


def _statements(batches: Iterator[pa.RecordBatch], dbs: Databases, forms: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for db, sql in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _judged(sql or "", dbs.names[db], dbs.keys[db])
            rows.append((db, sql, *own, forms and _is_free(sql or "", own, dbs.names[db], dbs.keys[db])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATEMENTS, strict=True)], schema=_STATEMENTS)


def statements(texts: DataFrame, dbs: Databases) -> DataFrame:
    """(db_id, sql, fingerprint, level, error, clauses, is_form) of different texts (db_id, sql); none is a form.

    ``clauses`` has an array for each of ``PARTS``, in that order.  A text that
    does not parse has an error, no level, and the clauses of an empty query.
    """
    return texts.select("db_id", "sql").mapInArrow(partial(_statements, dbs=dbs, forms=False), _STATEMENTS_DDL)


def statements_of(pairs: DataFrame, dbs: Databases) -> DataFrame:
    """What ``matched`` needs of both sides of pairs (id, db_id, gold_sql, pred_sql); a null prediction counts as an empty text.

    As ``statements``, but ``sql`` is a form (``is_form``) that stands for all its
    statements, or a statement whose literals matter: those of nested queries
    and of columns, for instance.
    """
    sides = pairs.select("db_id", F.col("gold_sql").alias("sql")).union(pairs.select("db_id", F.coalesce("pred_sql", F.lit(""))))
    different = sides.select("db_id", form(F.col("sql")).alias("sql")).distinct()
    forms = stored(different.mapInArrow(partial(_statements, dbs=dbs, forms=True), _STATEMENTS_DDL), "forms")
    rest = forms.filter("NOT is_form").select(F.col("db_id").alias("_d"), F.col("sql").alias("_f"))
    if rest.isEmpty():
        return forms
    alone = sides.join(rest, (F.col("db_id") == F.col("_d")) & form(F.col("sql")).eqNullSafe(F.col("_f")), "left_semi").distinct()
    return forms.filter("is_form").union(statements(alone, dbs))


def _with_side(pairs: DataFrame, known: DataFrame, side: str, sql: Column) -> DataFrame:
    """Pairs with what is known of one side, as a struct ``side``, by its form or else by its text."""
    told = F.struct("fingerprint", "level", "error")
    by = [known.filter(which).select(F.col("db_id").alias(f"_d{i}"), F.col("sql").alias(f"_s{i}"), told.alias(f"_t{i}")) for i, which in enumerate(("is_form", "NOT is_form"))]
    out = pairs.join(by[0], (F.col("db_id") == F.col("_d0")) & (form(sql) == F.col("_s0")), "left")
    out = out.join(by[1], (F.col("db_id") == F.col("_d1")) & (sql == F.col("_s1")), "left")
    return out.withColumn(side, F.coalesce("_t0", "_t1")).filter(F.col(side).isNotNull()).drop("_d0", "_s0", "_t0", "_d1", "_s1", "_t1")


def matched(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, db_id, hardness, exact_match, error, gold, pred) of pairs (id, db_id, gold_sql, pred_sql).

    Equi-joins of the pairs with ``known``, their ``statements_of``, by forms and
    by the texts of which no form is known; ``gold`` and ``pred`` are
    fingerprints.  A prediction that does not parse matches nothing.  A gold
    query that does not parse fails the job, as it is an error of the data.
    """
    out = _with_side(pairs.select("id", "db_id", "gold_sql", "pred_sql"), known, "g", F.col("gold_sql"))
    out = _with_side(out, known, "p", F.coalesce("pred_sql", F.lit("")))
    level = F.when(F.col("g.error").isNotNull(), F.raise_error(F.concat(F.lit("gold query: "), F.col("g.error")))).otherwise(F.col("g.level"))
    same = F.col("p.error").isNull() & (F.col("g.fingerprint") == F.col("p.fingerprint"))
    return out.select("id", "db_id", level.alias("hardness"), same.alias("exact_match"), F.col("p.error").alias("error"), F.col("g.fingerprint").alias("gold"), F.col("p.fingerprint").alias("pred"))


def part_scores(gold: Column, pred: Column) -> Column:
    """For each part a struct (part, score, label_total, pred_total), from two ``clauses``.

    Of connectors, differing sets report each other's sizes, as the measure does.
    """
    out = []
    for i, part in enumerate(PARTS):
        g, p = F.get(gold, F.lit(i)), F.get(pred, F.lit(i))
        same = (F.size(g) == F.size(p)) & (F.size(F.array_intersect(g, p)) == F.size(g))
        label, said = (F.when(same, 1).otherwise(F.size(p)), F.when(same, 1).otherwise(F.size(g))) if part == "and/or" else (F.size(g), F.size(p))
        out.append(F.struct(F.lit(part).alias("part"), same.cast("int").alias("score"), label.alias("label_total"), said.alias("pred_total")))
    return F.array(*out)


def partial_scores(details: DataFrame, known: DataFrame) -> DataFrame:
    """(hardness, part, acc, rec, f1) by level and of all, from ``matched`` details and their statements.

    Pairs are first counted by level and fingerprints; each different pair of
    fingerprints is scored once and weighs as its count.  Accuracy is over
    predictions that have the part, recall over golds that have it.
    """
    forms = known.groupBy("fingerprint").agg(F.first("clauses").alias("clauses"))
    counted = details.groupBy("hardness", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(forms.select(F.col("fingerprint").alias("gold"), F.col("clauses").alias("g")), "gold").join(forms.select(F.col("fingerprint").alias("pred"), F.col("clauses").alias("p")), "pred")
    each = counted.select("hardness", "n", F.explode(part_scores(F.col("g"), F.col("p"))).alias("s")).select("hardness", "n", "s.*")
    return each.sparkSession.sql(
        """
        SELECT hardness, part, acc, rec, CASE WHEN acc = 0 AND rec = 0 THEN 1.0D ELSE 2 * acc * rec / (acc + rec) END AS f1
        FROM (SELECT coalesce(hardness, 'all') AS hardness, part,
                     coalesce(CAST(sum(score * n) FILTER (WHERE pred_total > 0) AS DOUBLE) / sum(n) FILTER (WHERE pred_total > 0), 0.0D) AS acc,
                     coalesce(CAST(sum(score * n) FILTER (WHERE label_total > 0) AS DOUBLE) / sum(n) FILTER (WHERE label_total > 0), 0.0D) AS rec
              FROM {each} GROUP BY GROUPING SETS ((hardness, part), (part)))
        """,
        each=each,
    )
