import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.operators import matching, prompts, reports, schema, stats
from querent.functions import text as X
from querent.queries import CONCERT
from querent.sources import files
from querent.sources.descriptions import Descriptions, render


def load_letters(model):
    """An encoder for tests: two letter counts."""
    return lambda texts: np.array([[t.count("s") + 1e-3, t.count("c")] for t in texts])


@pytest.fixture(scope="module")
def schemas(spark):
    return schema.from_python(spark, [CONCERT])


def test_filters(spark):
    names = ["concert", "singer_id"]
    nouns = ["concert", "ca sĩ", "x", "tên ca sĩ rất là dài trong toàn bộ hệ thống", "Singer ID", "tên", "tên", "SELECT", "số lượng", " ca sĩ "]
    df = spark.createDataFrame([(0, nouns, names), (1, [], names)], "example_idx long, raw array<string>, names array<string>")
    r = matching.filter_counts(df).orderBy("example_idx").collect()
    assert r[0].kept == ["ca sĩ"] and r[0].nouns_after_filter == 1 and r[0].total_nouns_before_filter == 10
    assert (r[0].schema_name_duplicates_removed, r[0].too_short_removed, r[0].too_long_removed, r[0].vietnamese_stopwords_removed, r[0].english_nouns_removed) == (2, 1, 1, 3, 1)
    terms = matching.top_removed_stopwords(matching.filter_counts(df)).collect()
    assert [(t.term, t.n) for t in terms] == [("tên", 2), ("số lượng", 1)]
    assert df.select(X.is_kept(F.lit("nhà hát"))).first()[0] and r[1].kept == []


def test_best_targets_and_ties(spark):
    nouns = spark.createDataFrame([(0, "d", 0, "a", [1.0, 0.0]), (0, "d", 1, "b", [0.8, 0.6]), (1, "d", 0, "c", [0.0, 1.0]), (1, "e", 1, "z", [1.0, 0.0])], "example_idx long, db_id string, noun_pos int, vi_noun string, embedding array<float>")
    rows = [("d", 0, "singer", None, "entity", [1.0, 0.0]), ("d", 1, "other", None, "entity", [1.0, 0.0]), ("d", 2, "ref", None, "reference", [0.0, 1.0])]
    targets = spark.createDataFrame(rows, "db_id string, target_idx int, table string, column string, table_type string, embedding array<float>")
    got = [(r.vi_noun, r.table, r.similarity) for r in matching.best_targets(nouns, targets, 0.75).orderBy("vi_noun").collect()]
    assert got == [("a", "singer", 1.0), ("b", "singer", 0.8)]
    tables = [(r.vi_noun, r.table) for r in matching.best_tables(nouns.filter("db_id = 'd'"), targets, 0.5).orderBy("vi_noun").collect()]
    assert tables == [("a", "singer"), ("b", "singer"), ("c", "ref")]


def hints_frame(spark, rows):
    return spark.createDataFrame(rows, f"example_idx long, candidates array<string>, hints array<{matching.HINT}>")


def test_limit_hints(spark):
    h = [("n1", "singer", None, 0.8, "entity"), ("n2", "singer", None, 0.9, "entity"), ("n3", "singer", "Name", 0.85, "entity"), ("n4", "singer", "Age", 0.85, "entity"), ("n5", "concert", None, 0.1, "entity"), ("n6", "singer", None, 0.9, "entity")]
    r = matching.limit_hints(hints_frame(spark, [(0, [], h), (1, [], [])])).orderBy("example_idx").collect()
    assert [(x.vi_noun, x.column) for x in r[0].hints] == [("n2", None), ("n3", "Name"), ("n4", "Age")] and r[1].hints == []
    cut = matching.at_thresholds(matching.limit_hints(hints_frame(spark, [(0, [], h)])), [0.9, 0.85]).orderBy("threshold").collect()
    assert [len(c.hints) for c in cut] == [3, 1]


def test_stats(spark):
    df = hints_frame(spark, [(0, ["ca sĩ", "bài"], [("ca sĩ", "singer", None, 0.95, "entity"), ("x", "s", "Name", 1.0, "odd")]), (1, ["bài", "năm"], [])])
    s = stats.augment_stats(df, "m", 0.85).first().asDict(recursive=True)
    assert s["counts"] == {"total_examples": 2, "examples_with_hints": 1, "examples_without_hints": 1, "avg_hints_per_example": 1.0, "max_hints_in_one_example": 2}
    assert s["similarity_distribution"]["counts"] == [0] * 11 + [2]
    assert s["top_unmatched_nouns"] == [{"noun": "bài", "occurrences": 2}, {"noun": "năm", "occurrences": 1}]
    assert s["table_type_distribution"] == {"entity": 1, "reference": 0, "junction": 0, "odd": 1}
    assert s["match_level"] == {"table_level": 1, "column_level": 1} and s["filter_stats"]["nouns_after_filter"] == 4
    none = stats.augment_stats(df.limit(0), "m", 0.5).first()
    assert none.counts.total_examples == 0 and none.counts.avg_hints_per_example == 0.0 and none.match_level.table_level == 0


def test_augment_end_to_end(spark, schemas):
    tagged = [[("ssâ", "N"), ("ccâ", "N"), ("tên", "N")], []]
    examples = spark.createDataFrame([(i, "concert", t) for i, t in enumerate(tagged)], "example_idx long, db_id string, tagged array<struct<token: string, tag: string>>")
    t = schema.targets(schemas)
    vectors = matching.encode_texts(t, "m", load_letters).withColumnRenamed("text", "v")
    t = t.join(vectors, t.text == vectors.v).drop("v")
    out = matching.augment(examples, schema.schema_names(schemas), t, lambda x: matching.encode_texts(x, "m", load_letters), 0.9).orderBy("example_idx").collect()
    assert out[0].candidates == ["ssâ", "ccâ", "ssâ ccâ tên"] and out[0].hints[0].similarity >= 0.9 and out[1].hints == []
    assert matching.query_prefix("embeddinggemma-300m") == "" and matching.document_prefix("e5") == "passage: "
    matching.forget_encoder("m")


class TwoSided:
    """An encoder with a method for each side, as some families have."""

    def encode_query(self, texts):
        return [[3.0, 4.0] if not t.startswith("query") else [0.0, 0.0] for t in texts]

    def encode_document(self, texts):
        return [[0.0, float(len(t))] for t in texts]


def test_encoders_with_two_sides(spark):
    texts = spark.createDataFrame([("ab",), ("ab",), (None,), ("c",)], "text string")
    side = lambda kind, prefix="": {r.text: [round(x, 4) for x in r.embedding] for r in matching.encode_texts(texts, f"two-{kind}", lambda m: TwoSided(), prefix, kind=kind).collect()}
    assert side("query", "query: ") == {"ab": [0.6, 0.8], "c": [0.6, 0.8]}
    assert side("document") == {"ab": [0.0, 1.0], "c": [0.0, 1.0]}


def test_best_tables_in_parts(spark):
    nouns = spark.createDataFrame([(i, f"n{i}", [float(i), 1.0]) for i in range(6)], "noun_pos long, vi_noun string, embedding array<float>")
    tables = spark.createDataFrame([(j, f"t{j % 3}", [float(j % 3), 1.0]) for j in range(9)], "target_idx long, table string, embedding array<float>")
    whole, parts = (sorted(map(tuple, matching.best_tables(nouns, tables, 0.1, most).collect())) for most in (100, 2))
    assert whole == parts and len(whole) == 6


def test_prompts(spark, schemas):
    texts = schema.schema_texts(schemas)
    ex = spark.createDataFrame([(0, "concert", "Q?"), (1, "concert", "R?")], "example_idx long, db_id string, question string")
    hints = hints_frame(spark, [(0, [], [("n", "singer", None, 0.9, "entity"), ("m", "singer", "Name", 0.8, "entity")]), (1, [], [])])
    told = spark.createDataFrame([("concert", " about \n")], "db_id string, description_text string")
    plain = {r.example_idx: r.prompt for r in prompts.build_prompts(ex, texts).collect()}
    full = {r.example_idx: r for r in prompts.build_prompts(ex, texts, told, hints).collect()}
    only = {r.example_idx: r.prompt for r in prompts.build_prompts(ex, texts, None, hints).collect()}
    assert plain[1] == only[1] and plain[1].endswith("\n\nQuestion: R?" + prompts.CLOSING) and "sqlite_" not in plain[1]
    p = full[0].prompt
    assert p.index("about\n\nDatabase: concert") < p.index("Foreign Keys:") < p.index('  - "n" → table: singer\n  - "m" → singer.Name\n\nQuestion: Q?')
    assert [m.role for m in full[0].messages] == ["system", "user"]
    with pytest.raises(Exception, match="not found in tables.json"):
        prompts.build_prompts(ex.withColumn("db_id", F.lit("nope")), texts).collect()


DESCRIPTION = {"db_description": "Shows", "tables": {"sqlite_x": {}, "Singer": {"type": "entity", "description": "Artists", "columns": {"ID": "PK. key", "Name": "full name"}, "sample_values": {"Name": ["Ân"]}}, "Empty": {}}, "relationships": ["a -> b"], "join_hints": ["join"]}


def test_descriptions(spark, tmp_path, schemas):
    (tmp_path / "description_db.json").write_text(json.dumps({"Concert": DESCRIPTION}), encoding="utf-8")
    (tmp_path / "own.json").write_text(json.dumps({"db_description": "Own"}), encoding="utf-8")
    d = Descriptions(spark, str(tmp_path))
    text = d.text("concert")
    assert "Bảng: Singer [entity]\n  Mô tả: Artists\n  Mô tả cột:\n    - ID: PK. key\n    - Name: full name\n  Giá trị mẫu:\n    - Name: [\"Ân\"]\n" in text
    assert text.endswith("Quan hệ:\n  - a -> b\nGợi ý join:\n  - join") and "sqlite_x" not in text
    assert d.text("own").startswith("Database description:\nMô tả database: Own") and d.text("none") == "" == render({})
    rich = schema.rich_targets(d.rows(["concert"]), schemas).orderBy("target_idx").collect()
    assert [r.text for r in rich] == ["Singer Artists", "Singer Name full name", "Empty"]
    assert schema.rich_targets(d.rows([]), schemas).count() == 8
    assert Descriptions(spark, str(tmp_path / "absent")).text("x") == ""


def test_reports(spark):
    runs = spark.createDataFrame([("b", 1, 0.5, None), ("a", 1, 0.6, None), ("c", 1, None, 0.1)], "model string, n long, exact_match double, execution_accuracy double")
    assert reports.best_run(runs).first().model == "c" and reports.best_run(runs, "exact_match", "execution_accuracy").first().model == "a"
    cols = ["model", "n", "em", "ex"]
    d = {r.model: (r.d_em, r.d_ex) for r in reports.delta_table(runs.toDF(*cols).filter("model <> 'c'"), runs.toDF(*cols)).collect()}
    assert d == {"a": (0.0, None), "b": (0.0, None), "c": (None, None)}
    details = spark.createDataFrame([(True, None, False), (False, "e", True)], "exec_match boolean, error string, timeout boolean")
    assert reports.execution_summary(details).first().asDict() == {"count": 2, "matches": 1, "errors": 1, "timeouts": 1, "execution_accuracy": 0.5}
    assert "count" in reports.score_table([{"hardness": "all", "count": 1, "exact_match": 1.0}])
    assert "n/a" in reports.delta_text([{"model": "m", "n": 1, "em": None, "ex": 0.5, "d_em": None, "d_ex": 0.1}])


def test_files(spark, tmp_path):
    g = tmp_path / "gold.txt"
    g.write_text("﻿SELECT 'a\tb'\tdb1\n\n   \nSELECT 1\tdb2\n", encoding="utf-8")
    assert [tuple(r) for r in files.gold(spark, str(g)).orderBy("idx").collect()] == [(0, "SELECT 'a\tb'", "db1"), (1, "SELECT 1", "db2")]
    g.write_text("SELECT 1\tdb\nno tab\n", encoding="utf-8")
    with pytest.raises(ValueError, match="line 2"):
        files.gold(spark, str(g))
    p = tmp_path / "pred.txt"
    p.write_text("﻿SELECT 1\n\nSELECT 2\n", encoding="utf-8")
    assert [r.sql for r in files.predictions(spark, str(p)).orderBy("idx").collect()] == ["SELECT 1", "", "SELECT 2"]
    out = str(tmp_path / "deep" / "er" / "x.txt")
    files.write_lines(spark, out, [])
    assert [r.sql for r in files.predictions(spark, out).collect()] == [""]
    files.write_json(spark, str(tmp_path / "j.json"), {"a": "ấ"})
    assert "ấ" in (tmp_path / "j.json").read_text(encoding="utf-8") and files.read_json(spark, str(tmp_path / "j.json")) == {"a": "ấ"}
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "none.json"))
    data = files.Datasets.of_folder(spark, str(tmp_path))
    with pytest.raises(ValueError):
        data.load("examples", "other")
    with pytest.raises(FileNotFoundError):
        data.load_gold("examples", "dev")
    ex = spark.createDataFrame([(0,), (1,)], "example_idx long")
    (tmp_path / "h.json").write_text(json.dumps([{"index": 0, "db_id": "d", "question_vi": "q", "hints": [{"vi_noun": "n", "table": "t", "column": None, "similarity": 0.9, "table_type": "entity"}]}]))
    with pytest.raises(ValueError, match="missing 1"):
        files.hints(spark, str(tmp_path / "h.json"), ex)
    assert files.hints(spark, str(tmp_path / "h.json"), ex.filter("example_idx = 0")).first().hints[0].vi_noun == "n"
    (tmp_path / "h.json").write_text(json.dumps([{"index": 0, "hints": [{"vi_noun": "n"}]}]))
    with pytest.raises(ValueError, match="unsupported"):
        files.hints(spark, str(tmp_path / "h.json"), ex.filter("example_idx = 0"))
    files.save_results(spark, str(tmp_path / "r.json"), {"all": {"count": 1, "exact_match": 1.0}, "easy": {"count": 1, "exact_match": 1.0}}, {}, [])
    assert files.read_json(spark, str(tmp_path / "r.json"))["by_difficulty"]["easy"]["count"] == 1
    assert files.head(spark.createDataFrame([(0,), (1,), (2,)], "idx long"), 2).count() == 2


def brute_top(nouns, targets, threshold):
    """By hand, in double precision: (key, target) with the smallest target of the largest weighted product."""
    out = {}
    for db, key, x in nouns:
        scored = [(float((np.array(x) * np.array(v)).sum() * w), -t) for d, t, w, v in targets if d == db and v is not None and x is not None]
        if scored and max(scored)[0] >= threshold:
            out[db, key] = -max(scored)[1], max(scored)[0]
    return out


@pytest.mark.parametrize(("block", "slice_rows"), [(4096, 65_536), (7, 11), (1, 1000)])
def test_top_one_equals_brute_force(spark, block, slice_rows):
    """Ties, weights, a database with most of the nouns, negative products, and rows without a vector."""
    rng = np.random.default_rng(block)
    some = [rng.integers(-3, 4, 4).astype(float).tolist() for _ in range(12)]
    targets = [(f"d{i % 3}", i, float(rng.choice([1.0, 0.7, 0.6])), some[rng.integers(12)]) for i in range(60)] + [("d0", 99, 1.0, None), ("x", 0, 1.0, [1.0, 1, 1, 1])]
    nouns = [("d0" if i % 3 else f"d{i % 4}", i, some[rng.integers(12)]) for i in range(200)] + [("d1", 500, None), (None, 501, some[0])]
    nf = spark.createDataFrame(nouns, "db_id string, key int, embedding array<double>").repartition(3)
    tf = spark.createDataFrame([(d, t, w, v and [float(c) for c in v]) for d, t, w, v in targets], "db_id string, target_idx int, weight double, embedding array<double>")
    got = {(r.db_id, r.key): (r.target_idx, r.s) for r in matching.top_one(nf, tf, ["key"], 0.5, block, slice_rows).collect()}
    assert got == brute_top(nouns, targets, 0.5) and len(got) > 100


def test_top_one_stops_early():
    """Unit vectors by falling priority: nouns that match a table of the first priority never meet the rest."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    unit = lambda n: (v := rng.normal(size=(n, 8))) / np.linalg.norm(v, axis=1, keepdims=True)
    targets, weights = unit(3000), np.repeat([1.0, 0.7, 0.6], 1000)
    rows = pa.RecordBatch.from_arrays([pa.nulls(3000)] * 4 + [pa.array(range(3000), pa.int64()), pa.array(weights), pa.array(list(targets), pa.list_(pa.float64()))], names=list("abcdefg"))
    block = matching.TargetBlock(rows, 8)
    nouns = targets[rng.integers(0, 1000, 50)]
    at, s = block.best(nouns, 0.3)
    assert (s > 0.999).all() and (at < 1000).all() and block.chunks_seen == 4
    with pytest.raises(ValueError, match="lengths"):
        matching.matrix_of(pa.array([[1.0], [1.0, 2.0]]), 1)


def test_records_at_thresholds_equal_separate_runs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        names = [f"n{rng.integers(12)}" for _ in range(rng.integers(0, 6))]
        hints = [(str(n), "t", None if rng.random() < 0.5 else "c", float(round(rng.random(), 2)), str(rng.choice(["entity", "junction", "odd"])) if rng.random() < 0.9 else None) for n in names[:3]]
        rows.append((i, [str(n) for n in names], sorted(hints, key=lambda h: -h[3])))
    df = hints_frame(spark, rows).cache()
    steps = [0.7, 0.0, 0.45, 0.99, 0.2, 1.0]
    got = {r.config.threshold: r.asDict(recursive=True) for r in stats.records_at(df, "m", steps).collect()}
    assert sorted(got) == sorted(steps)
    for t in steps:
        cut = matching.at_thresholds(df, [t]).drop("threshold")
        want = stats.augment_stats(cut, "m", t).first().asDict(recursive=True)
        assert got[t] == want, t
    none = stats.records_at(hints_frame(spark, []), "m", [0.5]).first()
    assert none.counts.total_examples == 0 and none.top_unmatched_nouns == [] and none.match_level.column_level == 0


def test_lines_of_many_blocks_and_files(spark, tmp_path):
    """Numbers follow the files by name and the blocks of each, whatever splits a scan makes of them."""
    folder = tmp_path / "lines"
    folder.mkdir()
    want = []
    for name, n in (("b", 5000), ("a", 40), ("c", 3000)):
        own = [f"{name} line {i} " + "x" * (i % 90) for i in range(n)]
        (folder / f"{name}.txt").write_text("\n".join(own) + "\n")
        want.append((name, own))
    want = [x for _, own in sorted(want) for x in own]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = files.lines(spark, str(folder))
        got = [(r.line_no, r.line) for r in df.orderBy("line_no").collect()]
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == list(enumerate(want, 1))
    out = str(tmp_path / "written")
    files.write_lines_of(spark.range(500), out, F.concat(F.lit("n"), F.col("id").cast("string")), -F.col("id"), files=7)
    assert [r.sql for r in files.predictions(spark, out).orderBy("idx").collect()] == [f"n{i}" for i in range(499, -1, -1)]


def test_nouns_are_judged_in_rows_as_in_arrays(spark):
    """Candidates equal those of the array functions, and no list of names goes along with the nouns."""
    from pyspark.sql import functions as F

    from querent.functions.text import kept_nouns, noun_candidates

    tags = "array<struct<token: string, tag: string>>"
    nouns = [("ca", "N"), ("sĩ", "Np"), ("hát", "V"), ("Singer", "N"), ("tên", "N"), ("ca", "N"), (" ", "N"), ("đêm", "N"), (None, "N"), ("diễn", "N"), ("nhạc", None)]
    rows = [(0, "d", nouns), (1, "e", nouns), (2, None, nouns), (3, "d", []), (4, "d", None), (5, "none", nouns[:2]), (6, "d", [("hát", "V")])]
    examples = spark.createDataFrame(rows, f"example_idx long, db_id string, tagged {tags}")
    names = spark.createDataFrame([("d", ["Singer", "đêm"]), ("e", ["diễn", None, "CA"])], "db_id string, names array<string>")
    targets = spark.createDataFrame([("d", 0, "singer", None, "entity", [1.0, 0.0])], "db_id string, target_idx long, table string, column string, table_type string, embedding array<float>")
    out = matching.augment(examples, names, targets, lambda texts: texts.withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>")))
    raw = F.coalesce(noun_candidates(F.col("tagged")), F.array().cast("array<string>"))
    want = examples.join(names, "db_id", "left").withColumn("raw", raw).withColumn("kept", kept_nouns(F.col("raw"), F.coalesce("names", F.array().cast("array<string>"))))
    got = {r.example_idx: (r.db_id, r.raw, r.candidates) for r in out.collect()}
    assert got == {r.example_idx: (r.db_id, r.raw, r.kept) for r in want.collect()} and any(c for *_, c in got.values())
    assert "array_union" not in out._jdf.queryExecution().toString()


def test_equal_targets_are_asked_once(spark, tmp_path, monkeypatch):
    """Nouns meet the different vectors and weights of their database, however many targets have them."""
    import uuid

    ask = matching._top_one

    def counted(batches, **given):
        rows = []
        yield from ask((rows.append(b.num_rows) or b for b in batches), **given)
        (tmp_path / uuid.uuid4().hex).write_text(str(sum(rows)))

    monkeypatch.setattr(matching, "_top_one", counted)
    sides = [[0.6, 0.8], [0.8, 0.6], [0.0, 1.0]]
    targets = [("d", i, (1.0, 0.7)[i // 3 % 2], sides[i % 3]) for i in range(5, 900)] + [("e", 3, 1.0, sides[0]), ("e", 1, 1.0, sides[0])]
    nouns = [("de"[i % 2], i, sides[i % 3]) for i in range(60)]
    nf = spark.createDataFrame(nouns, "db_id string, key int, embedding array<double>")
    tf = spark.createDataFrame(targets, "db_id string, target_idx int, weight double, embedding array<double>")
    got = {(r.db_id, r.key): (r.target_idx, r.s) for r in matching.top_one(nf, tf, ["key"], 0.5, 10).collect()}
    assert got == brute_top(nouns, targets, 0.5) and len(got) == 60
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 60 + 6 + 1


def test_augment_encodes_and_matches_a_text_once(spark, tmp_path, monkeypatch):
    """Nouns that many examples have go to the encoder once, and to the targets once for each database."""
    import uuid

    ask, seen = matching._top_one, tmp_path / "seen"
    seen.mkdir()

    def load(model):
        def encode(texts):
            (seen / f"text-{uuid.uuid4().hex}").write_text(str(len(texts)))
            return [[0.0, 1.0] if t.endswith("hát") else [1.0, 0.0] for t in texts]

        return encode

    def counted(batches, **given):
        rows = []
        yield from ask((rows.append(sum(b.column(3).to_pylist())) or b for b in batches), **given)
        (seen / f"noun-{uuid.uuid4().hex}").write_text(str(sum(rows)))

    monkeypatch.setattr(matching, "_top_one", counted)
    total = lambda kind: sum(int(p.read_text()) for p in seen.glob(f"{kind}-*"))
    rows = [(i, f"d{i % 2}", [("ca sĩ", "N"), ("đi", "V"), ("bài hát", "N"), ("Tuổi", "N"), ("select", "V")]) for i in range(50)]
    examples = spark.createDataFrame(rows, "example_idx long, db_id string, tagged array<struct<token: string, tag: string>>")
    names = spark.createDataFrame([("d0", ["tuổi"]), ("d1", ["x"])], "db_id string, names array<string>")
    targets = spark.createDataFrame([(d, i, f"t{i}", None, "entity", v) for d in ("d0", "d1") for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])], "db_id string, target_idx long, table string, column string, table_type string, embedding array<float>")
    out = {r.example_idx: r for r in matching.augment(examples, names, targets, lambda x: matching.encode_texts(x, "once", load), 0.9).collect()}
    assert out[0].candidates == ["ca sĩ", "bài hát", "bài hát Tuổi"]
    assert out[1].candidates == ["ca sĩ", "bài hát", "Tuổi", "bài hát Tuổi"] and out[1].raw == out[0].raw == out[1].candidates
    assert [(h.vi_noun, h.table) for h in out[1].hints] == [("ca sĩ", "t0"), ("bài hát", "t1")] and len(out) == 50
    assert total("text") == 4 and total("noun") == 3 + 4


def test_table_types_of_wide_tables(spark):
    """The same types as counted column by column, from sets: no column is looked for among the keys by itself."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    some = lambda n: [rng.choice(["a", "b", "c", "d", "e", "", None]) for _ in range(rng.randrange(n))]
    rows = [(i, some(6), some(5)) for i in range(400)] + [(900, None, ["a", "b"]), (901, ["a"], None), (902, ["a", "b", "c", "c"], ["a", "b"])]
    out = spark.createDataFrame(rows, "id long, columns array<string>, fks array<string>").select("id", schema.table_type(F.lit("x"), F.col("columns"), F.col("fks")).alias("kind"))

    def kind(columns, fks):
        keys = {k for k in fks or [] if k}
        return "junction" if columns is not None and len(keys) >= 2 and sum(c is not None and c not in keys for c in columns) <= 1 else "entity"

    got = {r.id: r.kind for r in out.collect()}
    assert got == {i: kind(c, f) for i, c, f in rows} and set(got.values()) == {"junction", "entity"}
    assert "array_contains" not in out._jdf.queryExecution().toString()


def test_augment_takes_vectors_of_targets_once(spark, tmp_path):
    """Targets that are still to be encoded are encoded once, though counts, products and names ask for them."""
    import uuid

    def load(model):
        def encode(texts):
            (tmp_path / uuid.uuid4().hex).write_text(str(len(texts)))
            return [[1.0, 0.0]] * len(texts)

        return encode

    examples = spark.createDataFrame([(1, "d", [("hát", "N")])], "example_idx long, db_id string, tagged array<struct<token: string, tag: string>>")
    names = spark.createDataFrame([("d", ["x"])], "db_id string, names array<string>")
    texts = spark.createDataFrame([("d", i, f"t{i}", None, "entity", f"t{i}") for i in range(7)], "db_id string, target_idx long, table string, column string, table_type string, t string")
    vectors = matching.encode_texts(texts.withColumnRenamed("t", "text"), "targets-once", load).withColumnRenamed("text", "v")
    targets = texts.join(vectors, texts.t == vectors.v).drop("v", "t")
    out = matching.augment(examples, names, targets, lambda x: x.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")), 0.9).first()
    assert [(h.vi_noun, h.table) for h in out.hints] == [("hát", "t0")]
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 7
