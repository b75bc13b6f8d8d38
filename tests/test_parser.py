import pytest
from hypothesis import given
from hypothesis import strategies as st

from querent.plans import ir
from querent.plans.parser import Names, ParseError, is_valid, parse, tokenize
from querent.queries import ACCEPTED

TPCH = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]}
NAMES = Names(TPCH)


@pytest.mark.parametrize(("sql", "ok"), ACCEPTED)
def test_strict_grammar(sql, ok):
    assert is_valid(sql, NAMES) is ok


def test_tokens():
    assert tokenize("SELECT A FROM t WHERE x = 'It Is' ;") == ["select", "a", "from", "t", "where", "x", "=", '"It Is"', ";"]
    assert tokenize("a ! = 1 and b > = 2 and c < = 3") == ["a", "!=", "1", "and", "b", ">=", "2", "and", "c", "<=", "3"]
    assert tokenize("count(*),max(b)") == ["count", "(", "*", ")", ",", "max", "(", "b", ")"]
    assert tokenize("a>=5") == ["a", ">", "=5"] and tokenize("a>=5", strict=False) == ["a", ">=", "5"]
    assert tokenize("x in (1,2)") == ["x", "in", "(", "1,2", ")"]
    with pytest.raises(ParseError):
        tokenize("select 'a")


@given(st.text(alphabet="abc ()=<>!'\",.*12", max_size=40))
def test_no_other_errors(text):
    for strict in (True, False):
        is_valid("select " + text, NAMES, strict)


def test_quirks():
    q = parse("SELECT c_name FROM customer WHERE c_custkey = c_nationkey OR c_acctbal > 0", NAMES)
    assert len(q.where) == 1  # the OR branch is passed over
    q = parse("SELECT c_name FROM customer WHERE c_custkey = c_nationkey OR c_acctbal > 0", NAMES, strict=False)
    assert [x if isinstance(x, str) else x.op for x in q.where] == [2, "or", 3]
    q = parse("SELECT c_name FROM customer ORDER BY c_name DESC, c_acctbal ASC", NAMES)
    assert q.order[0] == "asc" and q.directions == ("desc", "asc")
    q = parse("SELECT max(c_acctbal - c_custkey) FROM customer", NAMES)
    assert q.items[0][0] == ir.AGGREGATES.index("max") and q.items[0][1].op == 1
    for where in ("", " WHERE c_custkey = 1"):  # HAVING needs GROUP BY before it
        with pytest.raises(ParseError):
            parse(f"SELECT c_name FROM customer{where} HAVING count(*) > 1", NAMES)
        assert parse(f"SELECT c_name FROM customer{where} HAVING count(*) > 1", NAMES, strict=False).having
    q = parse("SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region EXCEPT SELECT c_custkey FROM customer", NAMES)
    assert q.set_op[0] == "union" and q.set_op[1].set_op[0] == "except"
    q = parse("SELECT count(*) FROM (SELECT n_name FROM nation)", NAMES)
    assert q.sources[0].query is not None
    with pytest.raises(ParseError):
        parse("SELECT n_name FROM (SELECT n_name FROM nation)", NAMES)
    assert parse("SELECT n_name FROM nation LIMIT 3 nonsense after it", NAMES).limit == 3
    with pytest.raises(ParseError):
        parse("SELECT n_name FROM nation LIMIT x", NAMES)
    with pytest.raises(ParseError):
        parse("SELECT n_name FROM nation AS region", NAMES)


def test_aliases_do_not_count():
    a = parse("SELECT T1.n_name FROM nation AS T1", NAMES)
    b = parse("SELECT X.n_name FROM nation AS X", NAMES)
    assert a == b and ir.to_json(a) == ir.to_json(b)
