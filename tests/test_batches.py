"""Statements run together against each run alone, and fingerprints against the pairwise rules."""

import itertools
import random

import pytest

from querent.operators import batches, exact, execution, fingerprints
from querent.plans.compiler import Catalog, compile_query
from querent.plans.parser import parse
from querent.plans.templates import Types, abstract, is_simple, renamed
from querent.sources.catalogs import entry_of


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([(1, "Ann", 4.0, None), (2, "bob", 0.0, 7), (3, "O'x {y}", None, 7), (4, "ann", 4.0, 1)], "id int, name string, score double, ref long")
    u = spark.createDataFrame([(1, 0, "2020-01-01"), (7, 2, "2021-05-05"), (7, 3, None)], "id long, n int, day string").selectExpr("id", "n", "CAST(day AS TIMESTAMP_NTZ) AS day")
    return Catalog({"T": t, "u": u})


STATEMENTS = [
    "SELECT id FROM t WHERE id = 1", "SELECT id FROM t WHERE id = 2", "SELECT id FROM t WHERE id = '2'", "SELECT id FROM t WHERE id = 9", "SELECT id FROM t WHERE id < 'abc'",
    "SELECT count(*) FROM t WHERE id = 1", "SELECT count(*) FROM t WHERE id = 9", "SELECT count(*) FROM u WHERE id = 7", "SELECT max(id) FROM t WHERE name = 'nobody'", "SELECT min(id) FROM t WHERE name LIKE 'ANN'",
    "SELECT id FROM t ORDER BY id", "SELECT id FROM t ORDER BY id DESC", "SELECT id FROM t ORDER BY score LIMIT 2", "SELECT id FROM t WHERE id > 1 ORDER BY id LIMIT 1", "SELECT id FROM t WHERE id > 0 ORDER BY id LIMIT 0",
    "SELECT DISTINCT score FROM t WHERE id > 0", "SELECT DISTINCT score FROM t WHERE id > 0 ORDER BY score", "SELECT score FROM t WHERE id BETWEEN 1 AND 2", "SELECT score FROM t WHERE id NOT BETWEEN 2 AND 3",
    "SELECT ref, count(*) FROM t WHERE id > 0 GROUP BY ref HAVING count(*) > 1", "SELECT count(*), ref FROM t GROUP BY ref HAVING count(*) > 1 ORDER BY count(*) DESC", "SELECT ref, count(*) FROM t GROUP BY ref HAVING count(*) > 5",
    "SELECT A.id, B.id FROM t AS A JOIN t AS B ON A.ref = B.ref WHERE A.id < B.id", "SELECT X.id, Y.id FROM t AS X JOIN t AS Y ON X.ref = Y.ref WHERE X.id < Y.id", "SELECT t.name FROM t JOIN u ON t.ref = u.id WHERE u.n = 2 OR t.id = 1",
    "SELECT * FROM t WHERE id > 2", "SELECT id FROM t WHERE ref IS NULL", "SELECT id FROM t WHERE id IN (SELECT id FROM u)", "SELECT id FROM t UNION SELECT id FROM u ORDER BY id", "SELECT n FROM u WHERE day >= '2021-01-01'", "SELECT n FROM u WHERE day = 'no day'",
    "SELECT id FROM t WHERE score = 4", "SELECT id FROM t WHERE score = 4.0 AND name = 'Ann'", "SELECT id + n FROM t JOIN u ON t.ref = u.id", "SELECT missing FROM t", "no sql", "",
]


def alone(spark, catalog, sql):
    """(keys, rows, sorts) of a statement, or None."""
    try:
        q = parse(sql, catalog.names, strict=False)
        own = exact.normalise(parse(sql, catalog.names), catalog.names, {})
        rows = [tuple(r) for r in compile_query(spark, sql, catalog).collect()]
    except Exception:  # noqa: BLE001
        return None
    while q.set_op:
        q = q.set_op[1]
    return own, rows, bool(q.order)


def agree(p, g, ordered):
    if p is None or g is None:
        return False
    multiset = execution.same_result(p[1], g[1], p[0], g[0], ordered=False)
    if not ordered or not multiset or p[2] == g[2] is False:
        return multiset
    if p[2] and g[2]:
        return execution.same_result(p[1], g[1], p[0], g[0])
    return len(set(map(repr, g[1]))) <= 1


@pytest.mark.parametrize("ordered", [True, False])
def test_batch_equals_one_by_one(spark, catalog, ordered):
    pairs = [(i, "d", g, p) for i, (g, p) in enumerate(itertools.product(STATEMENTS, STATEMENTS))]
    df = spark.createDataFrame(pairs, "id long, db_id string, gold_sql string, pred_sql string").repartition(3)
    got = {r.id: r for r in batches.evaluate_pairs(spark, df, {"d": catalog}, {}, 120, ordered=ordered).collect()}
    own = {s: alone(spark, catalog, s) for s in STATEMENTS}
    wrong = [(g, p) for i, _, g, p in pairs if got[i].exec_match != agree(own[p], own[g], ordered)]
    assert not wrong and len(got) == len(pairs)
    assert all((got[i].error is not None) == (own[g] is None or own[p] is None) for i, _, g, p in pairs)
    hits = sum(r.exec_match for r in got.values())
    assert len(STATEMENTS) - 3 < hits < len(pairs) / 2
    scores = batches.accuracy(spark.createDataFrame([(True,), (False,)], "exec_match boolean")).first()
    assert tuple(scores) == (2, 0.5)


def test_templates(catalog):
    types = Types(catalog.types)
    forms = {}
    for sql in ("SELECT A.id FROM t AS A WHERE A.id = 1 AND A.name = 'x'", "SELECT B.id FROM t AS B WHERE B.id = 2 AND B.name = 'y'", "SELECT id FROM t WHERE id = 2.5 AND name = 'y'"):
        q, values = abstract(renamed(parse(sql, catalog.names, strict=False)), types)
        forms.setdefault(repr(q), []).append(values)
    assert sorted(forms.values()) == [[["1", "x"], ["2", "y"]], [["2.5", "y"]]]
    assert not is_simple(parse("SELECT id FROM t WHERE id IN (SELECT id FROM u)", catalog.names, strict=False))


def test_statements_of_a_form_are_parsed_once(catalog, monkeypatch):
    """A statement taken apart as one of a form is what it is by itself; more values make no more to parse."""
    book, rng = batches.Book(catalog, {}), random.Random(4)
    texts = [
        "SELECT id FROM t WHERE id = {n}", "SELECT id FROM t WHERE score > {n} AND name = {s}", "SELECT id FROM t WHERE id IN ( {n} , {n} ) OR name LIKE {s}", "SELECT id FROM t WHERE id = {s}", "SELECT id FROM t WHERE name = {n}", "SELECT n FROM u WHERE day >= {s}",
        "SELECT id FROM t WHERE id > {n} ORDER BY id LIMIT {k}", "SELECT id FROM t WHERE id IN (SELECT id FROM u WHERE n > {n})", "SELECT id FROM t WHERE id > - {n}", "SELECT id FROM t AS {n} WHERE id > {n}", "SELECT ref FROM t GROUP BY ref HAVING max(score) > {n} AND count(*) < {n}", "SELECT id FROM t WHERE id = {n} {n}",
    ]
    fill = lambda t: t.replace("{k}", rng.choice("34")) if "{" not in t.replace("{k}", "") else fill(t.replace("{n}", rng.choice(["5", "7", "-5", "-0", "5.5", "5.0", "1e3", "12345678901234567890", "9007199254740993"]), 1) if "{n}" in t else t.replace("{s}", rng.choice(["'a'", "'b'", "''", "'2'", '"3.5"', "'limit 5'", "'a 5 b'", "'nan'", "'it','s'"]), 1))
    forms = batches.Forms({"d": book})
    for sql in (fill(t) for t in texts * 60):
        assert forms.take_apart("d", sql) == batches.take_apart("d", sql, book), sql
    seen = []
    monkeypatch.setattr(batches, "parse", lambda *a, **k: (seen.append(a), parse(*a, **k))[1])
    rows = list(batches._take(iter([batches.pa.record_batch([["d"] * 500, [f"SELECT id FROM t WHERE id = {i} AND name = 'x{i}'" for i in range(500)]], names=["db_id", "sql"])]), {"d": book}))
    assert rows[0].num_rows == 500 and len(set(rows[0].column("stmt").to_pylist())) == 500 and len(seen) <= 4


def test_late_and_failing_templates_fail_alone(spark, catalog):
    rows = [(0, "d", "SELECT id FROM t WHERE id = 1", "SELECT id FROM t WHERE id = 1"), (1, "d", "SELECT id FROM t WHERE id = 1", None)]
    df = spark.createDataFrame(rows, "id long, db_id string, gold_sql string, pred_sql string")
    got = {r.id: r for r in batches.evaluate_pairs(spark, df, {"d": catalog}, {}, 0.001).collect()}
    assert got[0].timeout and not got[0].exec_match and got[1].error
    with pytest.raises(ValueError, match="templates"):
        batches.evaluate_pairs(spark, df, {"d": catalog}, {}, most_templates=0)
    assert batches.evaluate_pairs(spark, df.limit(0), {"d": catalog}, {}).collect() == []


def test_order_digest_combines_over_tasks(spark):
    """The same rows in the same order, cut into tasks differently, have one digest; any swap has another."""
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(400)]

    def digest(order, parts):
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(order)], "_s string, i int, _c0 int").repartitionByRange(parts, "i").sortWithinPartitions("i")
        return tuple(batches.digests(df.select("_s", "_c0"), [0], True).first())

    whole = digest(values, 1)
    assert digest(values, 7) == digest(values, 3) == whole and whole[1] == 400
    i = next(i for i in range(399) if values[i] != values[i + 1])
    swapped = digest([*values[:i], values[i + 1], values[i], *values[i + 2 :]], 4)
    assert swapped[:5] == whole[:5] and swapped[5:] != whole[5:]


# -- fingerprints

PARTS = [
    ["id", "id, name", "name, id", "count(*)", "count(*), name", "id, id", "DISTINCT id", "max(score - id)", "id, ref, name"],
    ["", " WHERE id = 1", " WHERE id > 2", " WHERE id = 1 AND name = 'x'", " WHERE name = 'y' AND id = 3", " WHERE id = 1 OR name = 'x'", " WHERE id NOT IN (SELECT id FROM u)", " WHERE id IN (SELECT n FROM u WHERE n = 1)", " WHERE id IN (SELECT n FROM u WHERE n = 2)", " WHERE id = 1 AND id = 1", " WHERE name LIKE 'a%'"],
    ["", " GROUP BY name", " GROUP BY name, id", " GROUP BY id, name", " GROUP BY name HAVING count(*) > 1", " GROUP BY name HAVING max(id) > 1"],
    ["", " ORDER BY id", " ORDER BY id DESC", " ORDER BY id LIMIT 3", " LIMIT 2", " ORDER BY name, id"],
    ["", " UNION SELECT id FROM u", " INTERSECT SELECT id FROM u", " UNION SELECT n FROM u WHERE n = 3"],
]


def some_statements(rng, n):
    out = ["SELECT t.id FROM t JOIN u ON t.ref = u.id", "SELECT t.id FROM t JOIN u ON u.id = t.ref", "SELECT u.id FROM u JOIN t ON t.ref = u.id", "SELECT A.id FROM t AS A JOIN t AS B ON A.id = B.ref"]
    weights = [1, 2, 4, 4, 6]
    for _ in range(n):
        a, *rest = ([*p, *[p[0]] * (len(p) * w // 4)] for p, w in zip(PARTS, weights, strict=True))
        out.append(f"SELECT {rng.choice(a)} FROM t" + "".join(rng.choice(p) for p in rest))
    return sorted(set(out))


@pytest.fixture(scope="module")
def dbs(catalog):
    return exact.Databases([entry_of(catalog, "d", [("t.ref", "u.id")])])


def test_equal_fingerprints_are_matches(catalog, dbs):
    names, keys = dbs.names["d"], dbs.keys["d"]
    forms = [exact.normalise(parse(s, names), names, keys) for s in some_statements(random.Random(1), 260)]
    marks, hits = [fingerprints.fingerprint(q) for q in forms], 0
    for (a, x), (b, y) in itertools.combinations(zip(forms, marks, strict=True), 2):
        assert exact.exact_match(a, b) == exact.exact_match(b, a) == (x == y)
        hits += x == y
    assert hits > 10


def test_scores_equal_pairwise_ones(spark, dbs):
    rng = random.Random(5)
    texts = some_statements(rng, 60)
    pairs = [(i, "d", rng.choice(texts), rng.choice([*texts, "nonsense", None])) for i in range(200)] + [(200 + i, "d", t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(pairs, "id long, db_id string, gold_sql string, pred_sql string").repartition(3).cache()
    known = fingerprints.statements_of(df, dbs).cache()
    details, want = fingerprints.matched(df, known).cache(), exact.score_pairs(df, dbs).cache()
    short = lambda d: sorted(map(tuple, d.select("id", "hardness", "exact_match", "error").collect()))
    assert short(details) == short(want)
    near = lambda rows: {(r.hardness, r.part): tuple(round(v, 9) for v in (r.acc, r.rec, r.f1)) for r in rows.collect()}
    assert near(fingerprints.partial_scores(details, known)) == near(exact.partial_level_scores(want))
    assert {tuple(r) for r in exact.level_scores(details).collect()} == {tuple(r) for r in exact.level_scores(want).collect()}


def test_gold_that_does_not_parse_is_raised(spark, dbs):
    df = spark.createDataFrame([(1, "d", "nonsense", "SELECT id FROM t")], "id long, db_id string, gold_sql string, pred_sql string")
    with pytest.raises(Exception, match="gold query"):
        fingerprints.matched(df, fingerprints.statements_of(df, dbs)).collect()


def test_statements_that_differ_in_literals_are_parsed_as_one_form(spark, dbs):
    """Literals do not make more to parse; where they matter, statements are told apart, with their own errors."""
    like = [f"SELECT id FROM t WHERE score > {v} AND name = {n} LIMIT {k}" for v in ("1", "-2.5", "1.25E7") for n in ("'a'", '"b ( 7 "') for k in (3, 4)]
    own = [
        *(f"SELECT id FROM t WHERE id IN ( SELECT n FROM u LIMIT {k} )" for k in (3, 4)), *(f"SELECT count(*) FROM ( SELECT id FROM t WHERE id > {k} )" for k in (3, 4)),
        *(f"SELECT id FROM t LIMIT {k}" for k in ("5", "5.5", "6.5")), *(f"SELECT id FROM t WHERE {k} = id" for k in ("5", "6", "5.5")), "SELECT id FROM t AS 5 JOIN u AS 6 ON 5.id = 6.id", "SELECT id FROM 5 AS t",
        "SELECT id FROM t WHERE name = 'a", "SELECT id FROM t WHERE id > 5,6", "SELECT id FROM t WHERE name = 'a' 'b'", "; SELECT id FROM t WHERE id > 7", "; SELECT id FROM t WHERE id > 8",
    ]
    golds = [s for s in [*like, *own] if fingerprints._judged(s, dbs.names["d"], dbs.keys["d"])[2] is None]
    df = spark.createDataFrame([(i, "d", g, p) for i, (g, p) in enumerate(itertools.product(golds, [*like, *own]))], "id long, db_id string, gold_sql string, pred_sql string")
    known = fingerprints.statements_of(df, dbs).cache()
    short = lambda d: sorted(map(tuple, d.select("id", "hardness", "exact_match", "error").collect()))
    assert short(fingerprints.matched(df, known)) == short(exact.score_pairs(df, dbs))
    alike = known.filter("sql LIKE 'SELECT id FROM t WHERE score > %'").collect()
    assert len(alike) == 2 and all(r.is_form for r in alike)


def test_no_pairs(spark, dbs):
    df = spark.createDataFrame([], "id long, db_id string, gold_sql string, pred_sql string")
    known = fingerprints.statements_of(df, dbs)
    details = fingerprints.matched(df, known)
    assert details.collect() == [] and fingerprints.partial_scores(details, known).collect() == []
    assert [tuple(r) for r in exact.level_scores(details).collect()] == [("all", 0, 0.0)]
