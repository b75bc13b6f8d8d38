"""Structural matching of predicted and gold queries: clause scores and hardness.

The IR is immutable, so normalising gives new queries and scoring the same pair
twice gives the same scores.  Pairs are scored in Arrow batches on the
executors; levels are a rollup over what comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.plans.ir import COMPARISONS, EMPTY, SET_OPS, Column, Condition, Query, Value, conditions, connectors
from querent.plans.parser import Names, ParseError, parse

#: The levels, and the clauses that are scored.
LEVELS = ("easy", "medium", "hard", "extra", "all")
PARTS = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords")


# -- normalising


def _map_conditions(flat: tuple, f: Callable[[Condition], Condition]) -> tuple:
    return tuple(f(x) if i % 2 == 0 and isinstance(x, Condition) else x for i, x in enumerate(flat))


def without_values(q: Query) -> Query:
    """Literals and right-hand columns go; nested queries stay and lose theirs."""

    def one(c: Condition) -> Condition:
        low, high = (without_values(v) if isinstance(v, Query) else None for v in (c.low, c.high))
        return replace(c, low=low, high=high)

    set_op = (q.set_op[0], without_values(q.set_op[1])) if q.set_op else None
    return replace(q, joins=_map_conditions(q.joins, one), where=_map_conditions(q.where, one), having=_map_conditions(q.having, one), set_op=set_op)


def foreign_key_sets(keys: list[tuple[int, int]]) -> list[set[int]]:
    """Columns joined by foreign keys: a key goes to the first set that has either end."""
    sets: list[set[int]] = []
    for pair in keys:
        home = next((s for s in sets if not s.isdisjoint(pair)), None)
        if home is None:
            sets.append(home := set())
        home.update(pair)
    return sets


def foreign_key_map(entry: Mapping) -> dict[str, str]:
    """Each column of a foreign-key set to the column of the set that is listed first."""
    tables = [t.lower() for t in entry["table_names_original"]]
    ids = [f"__{tables[t]}.{c.lower()}__" if t >= 0 else "__all__" for t, c in entry["column_names_original"]]
    return {ids[i]: ids[min(s)] for s in foreign_key_sets([tuple(k) for k in entry["foreign_keys"]]) for i in sorted(s)}


def canonical(q: Query, valid: set[str], keys: Mapping[str, str]) -> Query:
    """Columns by their key's first column, and without DISTINCT.

    Queries inside conditions and FROM stay as they are; operands of set
    operations change too, by the outer query's columns.
    """

    def column(c: Column | None) -> Column | None:
        return c and replace(c, name=keys[c.name] if c.name in keys and c.name in valid else c.name, distinct=None)

    def value(v: Value) -> Value:
        return Value(v.op, column(v.left), column(v.right))  # type: ignore[arg-type]

    def one(c: Condition) -> Condition:
        return replace(c, unit=value(c.unit))

    return replace(
        q,
        distinct=None,
        items=tuple((a, value(v)) for a, v in q.items),
        joins=_map_conditions(q.joins, one),
        where=_map_conditions(q.where, one),
        having=_map_conditions(q.having, one),
        group=tuple(column(c) for c in q.group),  # type: ignore[misc]
        order=(q.order[0], tuple(value(v) for v in q.order[1])) if q.order else (),
        set_op=(q.set_op[0], canonical(q.set_op[1], valid, keys)) if q.set_op else None,
    )


def normalise(q: Query, names: Names, keys: Mapping[str, str]) -> Query:
    base = {s.table[2:-2] for s in q.sources if s.table}
    return canonical(without_values(q), names.column_ids(base), keys)


# -- hardness


def _flat(q: Query) -> list[tuple]:
    return [q.joins, q.where, q.having]


def nested(q: Query) -> list[Query]:
    """Queries one level down: in conditions and as operands of set operations."""
    own = [v for flat in _flat(q) for c in conditions(flat) for v in (c.low, c.high) if isinstance(v, Query)]
    return own + ([q.set_op[1]] if q.set_op else [])


def clause_count(q: Query) -> int:
    used = bool(q.where) + bool(q.group) + bool(q.order) + (q.limit is not None) + max(0, len(q.sources) - 1)
    ors = sum(x == "or" for flat in _flat(q) for x in connectors(flat))
    likes = sum(c.op == COMPARISONS.index("like") for flat in _flat(q) for c in conditions(flat))
    return used + ors + likes


def aggregate_count(q: Query) -> int:
    """Aggregates as the measure counts them.

    A negated WHERE condition counts as one, and so does each negated condition
    and each connector in HAVING: the measure looks at a unit's first part.
    """
    n = sum(a != 0 for a, _ in q.items) + sum(c.negated for c in conditions(q.where)) + sum(c.agg != 0 for c in q.group)
    if q.order:
        n += sum(c.agg != 0 for v in q.order[1] for c in (v.left, v.right) if c)
    return n + sum(isinstance(x, str) or x.negated for x in q.having)


def other_count(q: Query) -> int:
    return (aggregate_count(q) > 1) + (len(q.items) > 1) + (len(q.where) > 1) + (len(q.group) > 1)


def hardness(q: Query) -> str:
    c, o, n = clause_count(q), other_count(q), len(nested(q))
    if n == 0:
        if c <= 1 and o == 0:
            return "easy"
        if c <= 1 and o <= 2 or c <= 2 and o < 2:
            return "medium"
        if c <= 2 and o > 2 or c == 3 and o <= 2:
            return "hard"
    elif n == 1 and c <= 1 and o == 0:
        return "hard"
    return "extra"


# -- scores


def _shared(a: list, b: list) -> int:
    """Size of the multiset intersection, by equality."""
    rest, n = list(b), 0
    for x in a:
        if x in rest:
            rest.remove(x)
            n += 1
    return n


def keywords(q: Query) -> set[str]:
    conds = [c for flat in _flat(q) for c in conditions(flat)]
    out = {k for k, used in (("where", q.where), ("group", q.group), ("having", q.having), ("order", q.order)) if used}
    out |= {q.order[0]} if q.order else set()
    out |= {"limit"} if q.limit is not None else set()
    out |= {q.set_op[0]} if q.set_op else set()
    out |= {"or"} if any(x == "or" for flat in _flat(q) for x in connectors(flat)) else set()
    out |= {"not"} if any(c.negated for c in conds) else set()
    return out | {k for k in ("in", "like") if any(c.op == COMPARISONS.index(k) for c in conds)}


def _counts(pred: Query, gold: Query) -> Iterator[tuple[str, int, int, int]]:
    """(part, gold total, prediction total, matching) for each part."""
    p, g = list(pred.items), list(gold.items)
    yield "select", len(g), len(p), _shared(p, g)
    yield "select(no AGG)", len(g), len(p), _shared([v for _, v in p], [v for _, v in g])
    p, g = conditions(pred.where), conditions(gold.where)
    yield "where", len(g), len(p), _shared(p, g)
    yield "where(no OP)", len(g), len(p), _shared([c.unit for c in p], [c.unit for c in g])
    p, g = [c.name for c in pred.group], [c.name for c in gold.group]
    bare = lambda names: [n.split(".")[1] if "." in n else n for n in names]
    yield "group(no Having)", len(g), len(p), _shared(bare(p), bare(g))
    both = bool(p) and bool(g)
    yield "group", int(bool(g)), int(bool(p)), int(both and p == g and pred.having == gold.having)
    same = bool(gold.order) and pred.order == gold.order and (pred.limit is None) == (gold.limit is None)
    yield "order", int(bool(gold.order)), int(bool(pred.order)), int(same)
    p, g = set(connectors(pred.where)), set(connectors(gold.where))
    yield ("and/or", 1, 1, 1) if p == g else ("and/or", len(p), len(g), 0)
    total_p = total_g = n = 0
    for op in SET_OPS:
        a, b = pred.operand(op), gold.operand(op)
        total_p += a is not None
        total_g += b is not None
        n += a is not None and b is not None and exact_match(a, b)
    yield "IUEN", total_g, total_p, n
    p, g = keywords(pred), keywords(gold)
    yield "keywords", len(g), len(p), len(p & g)


def partial_scores(pred: Query, gold: Query) -> dict[str, dict[str, int]]:
    """All or nothing: 1 where totals and matches agree, else 0."""
    out = {}
    for part, total_g, total_p, n in _counts(pred, gold):
        s = int(total_p == total_g and n == total_p)
        if part == "and/or" and not n:
            s = 0
        out[part] = {"acc": s, "rec": s, "f1": s, "label_total": total_g, "pred_total": total_p}
    return out


def exact_match(pred: Query, gold: Query) -> bool:
    if any(s["f1"] != 1 for s in partial_scores(pred, gold).values()):
        return False
    if not gold.sources:
        return True
    return len(gold.sources) == len(pred.sources) == _shared(list(pred.sources), list(gold.sources))


# -- evaluation of many pairs


class Databases:
    """Names and key maps of all databases; small next to the pairs, and checked to be."""

    def __init__(self, entries: list[Mapping], most: int = 20_000):
        if len(entries) > most:
            raise ValueError(f"more than {most} databases; score them in groups")
        self.names: dict[str, Names] = {}
        self.keys: dict[str, dict[str, str]] = {}
        for e in entries:
            tables: dict[str, list[str]] = {t: [] for t in e["table_names_original"]}
            for t, c in e["column_names_original"]:
                if t >= 0:
                    tables[e["table_names_original"][t]].append(c)
            self.names[e["db_id"]] = Names(tables)
            self.keys[e["db_id"]] = foreign_key_map(e)


def score_pair(gold_sql: str, pred_sql: str | None, names: Names, keys: Mapping[str, str]) -> dict:
    """One pair; a prediction that does not parse counts as an empty query.

    A gold query that does not parse is an error of the data and is raised.
    """
    gold, error = parse(gold_sql, names), None
    level = hardness(gold)
    try:
        pred = parse(pred_sql or "", names)
    except (ParseError, RecursionError) as e:
        pred, error = EMPTY, f"{type(e).__name__}: {e}"
    pred, gold = normalise(pred, names, keys), normalise(gold, names, keys)
    return {"hardness": level, "exact_match": exact_match(pred, gold), "error": error, "partial": partial_scores(pred, gold)}


_SCORE = pa.map_(pa.string(), pa.struct([(k, pa.int32()) for k in ("acc", "rec", "f1", "label_total", "pred_total")]))
_SCORED = pa.schema([("id", pa.int64()), ("db_id", pa.string()), ("hardness", pa.string()), ("exact_match", pa.bool_()), ("error", pa.string()), ("partial", _SCORE)])
SCORED_DDL = "id long, db_id string, hardness string, exact_match boolean, error string, partial map<string, struct<acc: int, rec: int, f1: int, label_total: int, pred_total: int>>"


def _score(batches: Iterator[pa.RecordBatch], dbs: Databases) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, db, gold, pred in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = score_pair(gold, pred, dbs.names[db], dbs.keys[db])
            rows.append((i, db, s["hardness"], s["exact_match"], s["error"], list(s["partial"].items())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCORED, strict=True)], schema=_SCORED)


def score_pairs(pairs: DataFrame, dbs: Databases) -> DataFrame:
    """Details of pairs (id, db_id, gold_sql, pred_sql): no shuffle, one pass."""
    return pairs.select(F.col("id").cast("long"), "db_id", "gold_sql", "pred_sql").mapInArrow(partial(_score, dbs=dbs), SCORED_DDL)


def level_scores(details: DataFrame) -> DataFrame:
    """(hardness, count, exact_match) of each level that occurs, and of all."""
    by = details.groupBy("hardness").agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("exact_match").cast("int")).alias("hits"))
    total = by.agg(F.lit("all").alias("hardness"), F.coalesce(F.sum("count"), F.lit(0)).alias("count"), F.sum("hits").alias("hits"))
    return by.union(total.select(*by.columns)).select("hardness", "count", F.when(F.col("count") > 0, F.col("hits") / F.col("count")).otherwise(0.0).alias("exact_match"))


def partial_level_scores(details: DataFrame) -> DataFrame:
    """Mean clause scores of each level: acc over predictions that have the part, rec over golds."""
    each = details.select("hardness", F.explode("partial").alias("part", "s"))
    mean = lambda k, total: F.coalesce(F.avg(F.when(F.col(f"s.{total}") > 0, F.col(f"s.{k}"))), F.lit(0.0))
    by = each.rollup("part", "hardness").agg(mean("acc", "pred_total").alias("acc"), mean("rec", "label_total").alias("rec")).filter("part IS NOT NULL")
    f1 = F.when((F.col("acc") == 0) & (F.col("rec") == 0), F.lit(1.0)).otherwise(2 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    return by.select(F.coalesce("hardness", F.lit("all")).alias("hardness"), "part", "acc", "rec", f1.alias("f1"))
