import pytest

from querent.operators import exact
from querent.operators.exact import exact_match, foreign_key_map, foreign_key_sets, hardness, normalise, partial_scores
from querent.plans.ir import EMPTY
from querent.plans.parser import Names, parse
from querent.queries import CONCERT, PAIRS

from .test_parser import TPCH

N = Names(TPCH)
KEYS = {"__customer.c_custkey__": "__customer.c_custkey__", "__orders.o_custkey__": "__customer.c_custkey__"}


def match(gold, pred, keys=KEYS):
    return exact_match(normalise(parse(pred, N), N, keys), normalise(parse(gold, N), N, keys))


@pytest.mark.parametrize(("sql", "level"), [
    ("SELECT count(*) FROM orders", "easy"),
    ("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus", "medium"),
    ("SELECT c_name FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", "hard"),
    ("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus ORDER BY count(*) DESC LIMIT 3", "hard"),
    ("SELECT o_orderstatus, count(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus ORDER BY count(*) DESC LIMIT 3", "extra"),
    ("SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal NOT BETWEEN 1 AND 2 AND n_regionkey NOT BETWEEN 3 AND 4", "extra"),
])
def test_hardness(sql, level):
    assert hardness(parse(sql, N)) == level


def test_having_connectors_count_as_aggregates():
    q = parse("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1 AND sum(o_totalprice) > 2 AND max(o_totalprice) > 3", N)
    assert exact.aggregate_count(q) == 2


@pytest.mark.parametrize(("gold", "pred", "want"), [
    ("SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 'x'", True),
    ("SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey > 1", False),
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_regionkey, n_name FROM nation", True),
    ("SELECT n_name, n_name FROM nation", "SELECT n_name, n_regionkey FROM nation", False),
    ("SELECT count(DISTINCT n_name) FROM nation", "SELECT count(n_name) FROM nation", True),
    ("SELECT n_name FROM nation ORDER BY n_name LIMIT 1", "SELECT n_name FROM nation ORDER BY n_name", False),
    ("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_nationkey = 2", False),
    ("SELECT n_name FROM nation UNION SELECT r_name FROM region", "SELECT n_name FROM nation EXCEPT SELECT r_name FROM region", False),
    ("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey", "SELECT c_name FROM orders JOIN customer ON c_custkey = o_custkey", True),
    ("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey", "SELECT c_name FROM customer", False),
    ("SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey", "SELECT c_custkey FROM orders JOIN customer ON c_custkey = o_custkey", True),
    ("SELECT o_custkey FROM orders", "SELECT c_custkey FROM customer", False),
])
def test_match(gold, pred, want):
    assert match(gold, pred) is want
    assert match(gold, pred) is want  # nothing was changed by the first call


def test_partial_scores():
    gold = normalise(parse("SELECT n_name, count(*) FROM nation WHERE n_regionkey = 1 GROUP BY n_name", N), N, {})
    pred = normalise(parse("SELECT n_name, sum(n_nationkey) FROM nation WHERE n_regionkey > 1 GROUP BY n_name", N), N, {})
    s = partial_scores(pred, gold)
    assert {k: v["f1"] for k, v in s.items()} == {"select": 0, "select(no AGG)": 0, "where": 0, "where(no OP)": 1, "group(no Having)": 1, "group": 1, "order": 1, "and/or": 1, "IUEN": 1, "keywords": 1}
    s = partial_scores(EMPTY, gold)
    assert s["select"] == {"acc": 0, "rec": 0, "f1": 0, "label_total": 2, "pred_total": 0} and s["order"]["f1"] == 1


def test_foreign_key_sets_are_sequential():
    assert foreign_key_sets([(1, 2), (3, 4), (2, 3)]) == [{1, 2, 3}, {3, 4}]  # two sets are never joined
    m = foreign_key_map(CONCERT)
    assert m["__singer_in_concert.singer_id__"] == "__singer.singer_id__" == m["__singer.singer_id__"]


def test_keys_need_their_table_in_from():
    gold = normalise(parse("SELECT o_custkey FROM orders", N), N, KEYS)
    assert gold.items[0][1].left.name == "__customer.c_custkey__"
    nested = normalise(parse("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", N), N, KEYS)
    assert nested.where[0].low.items[0][1].left.name == "__orders.o_custkey__"


def test_scores_on_spark(spark):
    entries = [{"db_id": "d", "table_names_original": list(TPCH), "column_names_original": [[-1, "*"], *([i, c] for i, t in enumerate(TPCH) for c in TPCH[t])], "foreign_keys": []}]
    dbs = exact.Databases(entries)
    pairs = spark.createDataFrame([(0, "d", "SELECT n_name FROM nation", "SELECT n_name FROM nation"), (1, "d", "SELECT n_name FROM nation", None), (2, "d", "SELECT n_name FROM nation LIMIT 1", "SELECT n_name FROM nation")], "id long, db_id string, gold_sql string, pred_sql string")
    details = exact.score_pairs(pairs, dbs).cache()
    assert [(r.exact_match, r.error is None) for r in details.orderBy("id").collect()] == [(True, True), (False, False), (False, True)]
    assert {r.hardness: (r["count"], round(r.exact_match, 4)) for r in exact.level_scores(details).collect()} == {"easy": (3, 0.3333), "all": (3, 0.3333)}
    parts = {(r.hardness, r.part): (r.acc, r.rec, r.f1) for r in exact.partial_level_scores(details).collect()}
    assert parts["all", "select"] == (1.0, pytest.approx(2 / 3), pytest.approx(0.8)) and parts["all", "order"] == (0.0, 0.0, 1.0)
    assert {r.hardness: r["count"] for r in exact.level_scores(details.limit(0)).collect()} == {"all": 0}
    with pytest.raises(Exception, match="ParseError"):
        exact.score_pairs(spark.createDataFrame([(0, "d", "nonsense", "x")], pairs.schema), dbs).collect()
    with pytest.raises(ValueError):
        exact.Databases(entries * 3, most=2)
    assert len(PAIRS) == 12
