"""Nouns on rows against the same functions on arrays."""

import random

from pyspark.sql import functions as F

from querent.functions import text as X
from querent.operators import nouns


def test_candidates_equal_those_of_arrays(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ca", "sĩ", " hát ", "", "tên", "  ", "bài", "năm", "x"])
    texts = [(i, [(word(), rng.choice(["N", "N", "Nc", "V", "P"])) for _ in range(rng.choice([0, 1, 3, 8, 40]))]) for i in range(120)] + [(None, [("a", "N"), ("b", "N")])]
    df = spark.createDataFrame(texts, "text_id long, tagged array<struct<token: string, tag: string>>")
    want = {r.text_id: r.c for r in df.select("text_id", X.noun_candidates(F.col("tagged")).alias("c")).collect()}
    tokens = df.select("text_id", F.posexplode("tagged").alias("pos", "t")).select("text_id", "pos", "t.token", "t.tag")
    got = {}
    for r in sorted(nouns.candidates(tokens).collect(), key=lambda r: r.place):
        got.setdefault(r.text_id, []).append(r.candidate)
    assert got == {k: v for k, v in want.items() if v}
    assert nouns.candidates(tokens.limit(0)).collect() == []


def test_reasons_equal_those_with_an_array_of_names(spark):
    names = [("a", "Singer_ID"), ("a", "tuổi thọ"), ("b", "nhà  hát"), ("b", None), ("c", "x")]
    items = ["singer id", "Singer_ID", "SINGER_id ", "tuổi_thọ", "nhà hát", "Nhà  Hát", "tên", "select", "ca sĩ", "x", "", " dài" * 12, "số lượng", "bài hát", "column"]
    pairs = [(d, n) for d in ("a", "b", "z") for n in items] * 2
    df = spark.createDataFrame(pairs, "db_id string, noun string")
    by = spark.createDataFrame([(d, [n for e, n in names if e == d and n]) for d in ("a", "b", "z")], "db_id string, names array<string>")
    want = {(r.db_id, r.noun): r.reason for r in df.join(by, "db_id").select("db_id", "noun", X.filter_reason(F.col("noun"), F.col("names")).alias("reason")).collect()}
    rows = nouns.reasons(df, spark.createDataFrame(names, "db_id string, name string")).collect()
    assert {(r.db_id, r.noun): r.reason for r in rows} == want and len(rows) == len(want)
    assert sum(v == "schema_name_duplicates_removed" for v in want.values()) > 4


def test_filter_totals_are_the_sums_of_examples(spark):
    """Nouns judged once each against each example by itself: null and empty lists and names, repeats, white space of any kind."""
    from querent.operators import matching, stats

    rows = [(1, ["tên", "Tên\u00a0", "a", "singer", "Singer ", "ca sĩ", "ca sĩ", "ca sĩ\u00a0", None], ["Singer"]), (2, ["ca sĩ", "singer", "", " ", "x" * 31], []), (3, [], ["Singer"]), (4, None, ["Singer"]), (5, ["concert", "ca sĩ", "hát"], None), (6, ["ca sĩ", "hát"], ["hát", None])]
    df = spark.createDataFrame(rows, "example_idx long, raw array<string>, names array<string>")
    want = stats.filter_stats(matching.filter_counts(df.filter("raw IS NOT NULL")), df).first()
    assert stats.filter_stats(matching.filter_totals(df), df).first() == want and want.nouns_after_filter > 0
    assert set(stats.filter_stats(matching.filter_totals(df.limit(0)), df).first()) == {0}


def test_tokens_are_dealt_once(spark):
    """Runs, repeats and places of a text are found where its tokens are: one exchange."""
    tokens = spark.createDataFrame([(1, 0, "a", "N"), (1, 1, "b", "N"), (1, 2, "a", "N")], "text_id long, pos int, token string, tag string")
    out = nouns.candidates(tokens)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a", False), (1, 1, "b", False), (1, 2, "a b a", True)]


def test_candidates_of_arrays_grow_with_tokens(spark):
    """Runs are cut by places, not grown token by token: null and blank tokens, null tags, null and empty arrays."""
    rows = [(0, [("a", "N"), (None, "N"), (" b ", "N"), ("c", "Np"), ("", "N"), ("d", None), ("b", "N"), ("c", "N")]), (1, []), (2, None), (3, [("x", "V")]), (4, [("a", "N"), ("a", "N"), None, ("a", "N")]), (5, [("w%d" % i, "NV"[i % 1000 == 999]) for i in range(20000)])]
    df = spark.createDataFrame(rows, "id long, tagged array<struct<token: string, tag: string>>")
    out = df.select("id", X.noun_candidates(F.col("tagged")).alias("c"), X.nouns(F.col("tagged")).alias("n"))
    got = {r.id: (r.c, r.n) for r in out.collect()}
    assert got[0] == (["a", "b", "c", "b c"], ["a", "b", "c"]) and got[4] == (["a", "a a"], ["a"])
    assert got[1] == got[3] == ([], []) and got[2] == (None, None)
    assert len(got[5][0]) == 20 * 1000 and got[5][0][999] == " ".join(f"w{i}" for i in range(999))
    assert "aggregate(" not in out._jdf.queryExecution().toString()


def test_plain_nouns_are_those_without_another_reason(spark):
    letters = ["a", "Z", "é", "ç", "đ", "日", "1", "_", "ß", "Ω"]
    rng = random.Random(5)
    items = ["", "a", "é", "tên", "TÊN", "số lượng", "x" * 31, "日本", "12", "ñ" * 3 + "a" * 7, "ñ" * 3 + "a" * 8] + ["".join(rng.choice(letters) for _ in range(rng.randrange(34))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in items], "noun string")
    rows = df.select("noun", (X.filter_reason(F.col("noun")) == "").alias("want"), X.is_plain(F.col("noun")).alias("got")).collect()
    assert all(r.want == r.got for r in rows) and 0 < sum(r.got for r in rows) < len(rows)
    assert not spark.createDataFrame([(None,)], "noun string").select(X.is_plain(F.col("noun")).alias("p")).first().p
