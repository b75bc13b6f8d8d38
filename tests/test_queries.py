"""All base queries against their oracles in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from querent.queries import ORACLES, QUERIES
from querent.streaming.scoring import level_counts, score_stream


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(names), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    #: A few conditions need more rows than the smallest tables have; none may give nothing on the next size.
    assert got[1] or not QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).isEmpty()
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(ORACLES) <= set(entry.queries())


def test_stream(spark, sf, tmp_path):
    from querent import queries as q

    pairs = q._pairs(spark)
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    run = level_counts(score_stream(stream, q._databases(spark, sf))).writeStream.format("memory").queryName("scored").outputMode("complete").start()
    try:
        run.processAllAvailable()
        got = {r.hardness: (r["count"], r.matches) for r in spark.sql("SELECT * FROM scored").collect()}
    finally:
        run.stop()
    assert got == {h: (len(v), sum(v)) for h, v in q._BY.items() if h != "all"}
