import pytest

import __spark_entry__ as entry
import corpus_pipeline
from querent.llm import quality
from querent.llm.queries import ORACLE_SQL, QUERIES


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in names if q.startswith("op")}
    assert names["pipeline"] is corpus_pipeline.run and len(QUERIES) == 13


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        after = f(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_act(spark, stages, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, before, after in stages[:-1]:
        assert after.columns == names, name
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in d1.collect()}
    all_ids = {r.doc_id for r in d0.collect()}
    assert all(d in kept for d, q in labels.items() if q == 1 and d in all_ids)
    assert len(kept) < len(all_ids)
    assert {r.doc_id for r in d2.collect()} <= kept
    assert d3.count() <= d2.count() and d3.select("doc_id").distinct().count() == d3.count()
    assert {r.doc_id for r in d4.collect()} == {r.doc_id for r in d3.collect()}
    packed = d5.toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in d3.collect()} and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_near_duplicate_stage_equals_brute_force(stages):
    from .test_ngram_join import brute

    _, before, after = stages[2]
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in after.collect()} == want


def test_quality_stage_equals_scores(spark, stages, sf):
    _, before, after = stages[0]
    model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality.score(before, model).collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
    assert {r.doc_id for r in after.collect()} == want


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*(f"`{n}`" for n in names)).collect())) == sorted(cur.fetchall())
