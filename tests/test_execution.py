import sqlite3
import time

import pytest

from querent.operators import execution
from querent.plans.compiler import Catalog, compile_query
from querent.plans.parser import parse
from querent.sources.catalogs import entry_of, of_sqlite, schema_of, schema_of_json
from querent.sources.sqlite_scan import of_shared_sqlite


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([(1, "Ann", 4.0, None), (2, "bob", 0.0, 7), (3, "O'x {y}", None, 7)], "id int, name string, score double, ref long")
    return Catalog({"T": t, "u": spark.createDataFrame([(1, 0), (7, 2)], "id long, n int")})


def rows(spark, catalog, sql):
    return [tuple(r) for r in compile_query(spark, sql, catalog).collect()]


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT ref / id, id / score FROM t WHERE id = 2", [(3, None)]),
    ("SELECT name FROM t WHERE name LIKE 'ANN'", [("Ann",)]),
    ("SELECT id FROM t WHERE name = \"O'x {y}\"", []),
    ("SELECT id FROM t WHERE score = '4'", [(1,)]),
    ("SELECT id FROM t WHERE score < 'abc' ORDER BY id", [(1,), (2,)]),
    ("SELECT id FROM t WHERE name = 5", []),
    ("SELECT id FROM t WHERE id IN (1, 3) ORDER BY id DESC", [(3,), (1,)]),
    ("SELECT id FROM t WHERE ref IS NULL", [(1,)]),
    ("SELECT id FROM t WHERE id > (SELECT id FROM t ORDER BY id LIMIT 1) AND ref IS NOT NULL ORDER BY id", [(2,), (3,)]),
    ("SELECT id FROM t ORDER BY score", [(3,), (2,), (1,)]),
    ("SELECT id FROM t WHERE id NOT IN (SELECT ref FROM t)", []),
    ("SELECT count(*), max(name) FROM t GROUP BY ref ORDER BY count(*)", [(1, "Ann"), (2, "bob")]),
    ("SELECT name, max(id) FROM t", [("O'x {y}", 3)]),
    ("SELECT id FROM t EXCEPT SELECT id FROM u UNION SELECT n FROM u ORDER BY id", [(0,), (2,), (3,)]),
    ("SELECT a.id, b.id FROM t AS a JOIN t AS b ON a.ref = b.ref AND a.id < b.id", [(2, 3)]),
    ("SELECT count(*) FROM (SELECT DISTINCT ref FROM t)", [(2,)]),
    ("SELECT id FROM t WHERE id BETWEEN 2 AND 3 ORDER BY id LIMIT 1", [(2,)]),
    ("SELECT ref - id FROM t WHERE id <> 1 ORDER BY id", [(5,), (4,)]),
])
def test_sqlite_semantics(spark, catalog, sql, want):
    if "{y}\"" in sql and sql.startswith("SELECT id FROM t WHERE name = \""):
        with pytest.raises(ValueError):
            rows(spark, catalog, sql)  # three quotes, after all are made double
        return
    assert rows(spark, catalog, sql) == want


def test_braces_in_literals(spark, catalog):
    assert rows(spark, catalog, "SELECT count(*) FROM t WHERE name LIKE '%{y}'") == [(1,)]


def test_evaluate(spark, catalog):
    gold = [("SELECT id FROM t ORDER BY id", "d")] * 4
    pred = ["SELECT id FROM t ORDER BY id DESC", "SELECT id FROM t ORDER BY id", "SELECT missing FROM t", ""]
    scores, details = execution.evaluate(spark, gold, pred, {"d": catalog}, {}, 60, parallel=2)
    assert [d["exec_match"] for d in details] == [False, True, False, False] and scores["all"] == {"count": 4, "execution_accuracy": 0.25}
    assert details[2]["error"].startswith("pred_sql: ") and not details[2]["timeout"]
    loose, _ = execution.evaluate(spark, gold[:1], pred[:1], {"d": catalog}, {}, 60, ordered=False)
    assert loose["all"]["execution_accuracy"] == 1.0
    assert execution.evaluate(spark, [], [], {}, {})[0]["all"] == {"count": 0, "execution_accuracy": 0.0}
    with pytest.raises(ValueError):
        execution.evaluate(spark, gold, pred[:1], {"d": catalog}, {})
    with pytest.raises(ValueError):
        execution.evaluate(spark, gold, pred, {"d": catalog}, {}, 0)


def test_deadline(spark):
    slow = lambda: spark.range(400_000).crossJoin(spark.range(400_000)).toDF("a", "b").selectExpr("sum(sqrt(a * b))")
    t = time.monotonic()
    out = execution.run_with_deadline(spark, slow, 2)
    assert out.timeout and out.rows is None and out.error and time.monotonic() - t < 60
    many = execution.run_with_deadline(spark, lambda: spark.range(10), 60, most_rows=5)
    assert many.more and many.rows is None and many.error is None


def test_large_results_are_compared_in_place(spark):
    """Beyond the limit, hashes decide as the rows would: order, values, columns and counts."""
    base = spark.range(0, 3000, 1, 5).selectExpr("id", "CAST(id AS DOUBLE) AS same", "id % 7 AS g", "IF(id % 5 = 0, NULL, concat('x', id)) AS name")
    c = Catalog({"t": base, "u": base.selectExpr("same AS id", "same", "g", "name")})
    pairs = [
        ("SELECT id, name FROM t ORDER BY id", "SELECT name, id FROM t ORDER BY id"),
        ("SELECT id, name FROM t ORDER BY id", "SELECT id, name FROM t ORDER BY id DESC"),
        ("SELECT id FROM t ORDER BY id", "SELECT id FROM t WHERE id != 5 ORDER BY id"),
        ("SELECT g FROM t ORDER BY id", "SELECT id FROM t ORDER BY id"),
    ]
    for ordered, want in ((True, [True, False, False, False]), (False, [True, True, False, False])):
        for most in (10, 100_000):
            _, details = execution.evaluate(spark, [(g, "d") for g, _ in pairs], [p for _, p in pairs], {"d": c}, {}, 60, ordered=ordered, most_rows=most)
            assert [d["exec_match"] for d in details] == want and not [d["error"] for d in details if d["error"]]
    q = parse("SELECT id, name FROM t", c.names)
    sums = [execution.digest(c.tables[t].select("id", "name").orderBy("id"), q, True).first() for t in "tu"]
    assert sums[0] == sums[1] and sums[0][0] == 3000


@pytest.mark.parametrize("journal", ["delete", "wal"])
def test_sqlite_files(spark, tmp_path, journal):
    con = sqlite3.connect(tmp_path / "shop.sqlite")
    con.execute(f"PRAGMA journal_mode = {journal}")
    con.executescript("CREATE TABLE item (id INTEGER PRIMARY KEY, \"unit price\" REAL, label TEXT, mixed, day DATE); CREATE TABLE bare (n INTEGER);")
    con.executemany("INSERT INTO item VALUES (?, ?, ?, ?, ?)", [(1, 2, "a\u00e9", 5, "2020-01-02"), (2, 2.5, None, "x", None), (3, None, "c", b"yz", "2021-01-02")])
    con.commit()
    con.close()
    c = of_sqlite(spark, str(tmp_path / "shop.sqlite"))
    assert c.tables["item"].dtypes == [("id", "bigint"), ("unit price", "double"), ("label", "string"), ("mixed", "string"), ("day", "string")]
    assert c.tables["bare"].count() == 0 and c.tables["bare"].dtypes == [("n", "bigint")]
    assert [tuple(r) for r in c.tables["item"].orderBy("id").collect()] == [(1, 2.0, "a\u00e9", "5", "2020-01-02"), (2, 2.5, None, "x", None), (3, None, "c", "yz", "2021-01-02")]
    scores, details = execution.evaluate(spark, [("SELECT count(*) FROM item", "shop")] * 2, ["SELECT count(*) FROM item", "SELECT missing_column FROM item"], {"shop": c}, {}, 60)
    assert scores["all"]["execution_accuracy"] == 0.5 and details[1]["error"]


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    path = tmp_path_factory.mktemp("shop") / "shop ü.sqlite"
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE Item (id INTEGER PRIMARY KEY, price REAL, label TEXT COLLATE NOCASE, mixed, extra TEXT); CREATE TABLE flat (k TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID; CREATE TABLE bare (n INTEGER); CREATE VIEW dear AS SELECT id FROM Item WHERE price > 90;")
    con.executemany("INSERT INTO Item VALUES (?, ?, ?, ?, ?)", [(i * 3, None if i % 11 == 0 else i % 100, ["Ab", "ab", "é", None][i % 4], [i, str(i), float(i)][i % 3], "x" * 50) for i in range(4000)])
    con.executemany("INSERT INTO flat VALUES (?, ?)", [(f"k{i}", i) for i in range(50)])
    con.commit()
    con.close()
    return str(path)


@pytest.mark.parametrize("sql", [
    "SELECT id, label FROM item WHERE id = 300", "SELECT count(*) FROM item WHERE price > 50 AND id < 6000", "SELECT count(*) FROM item", "SELECT id FROM item WHERE label = 'ab' AND id < 100", "SELECT id FROM item WHERE label != 'ab' AND id < 100",
    "SELECT id FROM item WHERE label IS NULL AND id > 11900", "SELECT id FROM item WHERE price IS NOT NULL AND id IN (0, 33, 36)", "SELECT id FROM item WHERE mixed = '7'", "SELECT id FROM item WHERE mixed > '3990' AND id > 11900", "SELECT id FROM item WHERE id NOT IN (SELECT id FROM item WHERE price < 95) AND price > 1",
    "SELECT n FROM flat WHERE k = 'k7'", "SELECT count(*) FROM bare", "SELECT count(*) FROM dear WHERE id > 300", "SELECT * FROM item WHERE id = 9", "SELECT max(T1.price) FROM item AS T1 JOIN flat AS T2 ON T1.id = T2.n WHERE T2.n < 20",
])
def test_shared_sqlite_equals_bytes(spark, shop, sql):
    """Filters in the statement of each range give what Spark's filters over the whole file give."""
    whole, scan = of_sqlite(spark, shop), of_shared_sqlite(spark, shop, partitions=5)
    assert scan.types == whole.types
    assert sorted(map(repr, compile_query(spark, sql, scan).collect())) == sorted(map(repr, compile_query(spark, sql, whole).collect()))


def test_shared_sqlite_prunes_and_pushes(spark, shop):
    c = of_shared_sqlite(spark, shop, partitions=5)
    df = compile_query(spark, "SELECT id FROM item WHERE price > 50 AND id < 6000", c)
    plan = df._jdf.queryExecution().executedPlan().toString()
    #: The scan took both filters over, so no Filter is left, and reads two columns.
    assert "BatchScan sqlite_table[id" in plan and "Filter [" not in plan and "Filter (" not in plan and "extra" not in plan and "label" not in plan
    assert df.rdd.getNumPartitions() == 5 and df.count() == 890
    text = compile_query(spark, "SELECT id FROM item WHERE label = 'ab'", c)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in text.replace("RuntimeFilters", "")
    assert c.tables["bare"].rdd.getNumPartitions() == 1 and c.tables["flat"].rdd.getNumPartitions() == 1
    _, details = execution.evaluate(spark, [("SELECT count(*) FROM item", "shop")], ["SELECT count(*) FROM item"], {"shop": c}, {}, 60)
    assert details[0]["exec_match"]


def test_result_map_keys(catalog):
    q = parse("SELECT max(id), min(id), count(*) FROM t", catalog.names)
    assert len(execution.result_map([(3, 1, 3)], q)) == 2  # the outer aggregate is no part of a key
    both = parse("SELECT id, name FROM t", catalog.names), parse("SELECT name, id FROM t", catalog.names)
    assert execution.same_result([(1, "a")], [("a", 1)], *both)


def test_filters_reach_the_scan(spark, sf):
    c = Catalog.of_folder(spark, sf, ["orders"])
    plan = compile_query(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000", c)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan and "o_orderstatus" not in plan


def test_catalog_entries(catalog):
    e = entry_of(catalog, "d", [("u.id", "t.id")])
    assert e["foreign_keys"] == [[5, 1]] and schema_of(catalog) == {"t": ["id", "name", "score", "ref"], "u": ["id", "n"]}
    assert schema_of_json([{"table": "A", "col_data": [{"column_name": "B"}]}]) == {"a": ["b"]}


def test_not_in_reads_all_orders(spark):
    """r08_not_in: a customer of any order is out, whatever the order's price, so only the one without orders is left."""
    import duckdb

    from querent.queries import ORACLES, RELATIONAL

    customers, orders = [(1,), (2,), (3,)], [(1, 10.0), (2, 500000.0)]
    tables = {"customer": spark.createDataFrame(customers, "c_custkey long"), "orders": spark.createDataFrame(orders, "o_custkey long, o_totalprice double")}
    assert [tuple(r) for r in compile_query(spark, RELATIONAL["r08_not_in"][0], Catalog(tables)).collect()] == [(3,)]
    c = duckdb.connect()
    c.execute("CREATE TABLE customer AS SELECT * FROM (VALUES (1), (2), (3)) t(c_custkey)")
    c.execute("CREATE TABLE orders AS SELECT * FROM (VALUES (1, 10.0), (2, 500000.0)) t(o_custkey, o_totalprice)")
    assert c.execute(ORACLES["r08_not_in"]).fetchall() == [(3,)]
