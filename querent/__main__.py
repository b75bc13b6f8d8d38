"""Command line: prompts and structural scores, execution accuracy, thresholds, reports.

Models are external: ``score`` takes an answers file in place of a model run,
``infer`` a module that loads a generator, ``hints`` one that loads an encoder
and a file of tagged questions.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querent.functions.text import prediction
from querent.operators import exact, execution, generation, matching, prompts, reports, schema, stats
from querent.session import session
from querent.sources import files
from querent.sources.catalogs import of_database, of_sqlite
from querent.sources.descriptions import Descriptions


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="querent", description=__doc__.splitlines()[0])
    p.add_argument("--master")
    sub = p.add_subparsers(dest="mode", required=True)

    def data(s: argparse.ArgumentParser) -> None:
        s.add_argument("--data", required=True, help="folder of the dataset, gold and schema files")
        s.add_argument("--dataset", default="examples")
        s.add_argument("--split", default="dev", choices=["dev", "test", "train"])
        s.add_argument("--limit", type=int)

    s = sub.add_parser("prompts", help="write prompts and chat messages")
    data(s)
    s.add_argument("--hints-input")
    s.add_argument("--descriptions-dir")
    s.add_argument("--descriptions-file")
    s.add_argument("--no-descriptions", action="store_true")
    s.add_argument("--output", required=True)

    def scored(s: argparse.ArgumentParser) -> None:
        s.add_argument("--hints-input")
        s.add_argument("--model", default="unknown")
        s.add_argument("--predictions-output", required=True)
        s.add_argument("--gold-output", required=True)
        s.add_argument("--output", required=True)

    s = sub.add_parser("score", help="exact match of model answers")
    data(s)
    scored(s)
    s.add_argument("--answers", required=True, help="one JSON object {id, answer} a line")

    s = sub.add_parser("infer", help="prompts, answers of a model, and their exact match, in one call")
    data(s)
    scored(s)
    s.add_argument("--generator", required=True, help="module:function; function(model) gives lists of chats -> answers")
    s.add_argument("--answers-output", required=True, help="Parquet folder of answers; a run goes on with those it lacks")
    s.add_argument("--batch-size", type=int, default=32)
    s.add_argument("--descriptions-dir")
    s.add_argument("--descriptions-file")
    s.add_argument("--no-descriptions", action="store_true")

    s = sub.add_parser("exec", help="execution accuracy of predictions")
    s.add_argument("--data", required=True)
    s.add_argument("--predictions-input", required=True)
    s.add_argument("--gold-input")
    s.add_argument("--output")
    s.add_argument("--exec-details-output")
    s.add_argument("--em-input")
    s.add_argument("--timeout-seconds", type=float, default=30.0)
    s.add_argument("--sqlite-dir", help="folder of NAME/NAME.sqlite files; without it, databases of Spark's catalog")
    s.add_argument("--multiset", action="store_true", help="leave row order out of the comparison")
    s.add_argument("--model", default="unknown")
    s.add_argument("--dataset", default="unknown")

    s = sub.add_parser("hints", help="hints and statistics at one or more thresholds")
    data(s)
    s.add_argument("--tagged", required=True, help="JSON array of {index, tagged: [{token, tag}]}")
    s.add_argument("--encoder", required=True, help="module:function; function(model) gives texts -> matrix")
    s.add_argument("--model", default="intfloat/multilingual-e5-large-instruct")
    s.add_argument("--thresholds", nargs="+", type=float, default=[0.82, 0.85, 0.87, 0.90])
    s.add_argument("--descriptions-dir")
    s.add_argument("--descriptions-file")
    s.add_argument("--output-root", required=True)
    s.add_argument("--output-suffix", default="")

    s = sub.add_parser("compare", help="delta table and best run of two folders of runs")
    s.add_argument("--baseline", required=True)
    s.add_argument("--augmented")
    s.add_argument("--primary", default="execution_accuracy", choices=["execution_accuracy", "exact_match"])
    s.add_argument("--output")
    return p.parse_args(argv)


def _examples(spark: SparkSession, a: argparse.Namespace) -> tuple[files.Datasets, list[dict]]:
    store = files.Datasets.of_folder(spark, a.data, a.dataset)
    rows = store.load(a.dataset, a.split)
    return store, rows[: a.limit] if a.limit else rows


def _frame(spark: SparkSession, rows: list[dict]):
    return spark.createDataFrame([(i, r["db_id"], r.get("question_vi", r.get("question", ""))) for i, r in enumerate(rows)], "example_idx long, db_id string, question string")


def _prompts(spark: SparkSession, a: argparse.Namespace):
    """(example_idx, db_id, prompt, messages) of the examples."""
    store, rows = _examples(spark, a)
    examples = _frame(spark, rows)
    texts = schema.schema_texts(schema.from_python(spark, list(store.load_tables().values())))
    told = None
    if a.descriptions_dir and not a.no_descriptions:
        told = Descriptions(spark, a.descriptions_dir, a.descriptions_file).texts(sorted({r["db_id"] for r in rows}))
    hints = files.hints(spark, a.hints_input, examples) if a.hints_input else None
    return prompts.build_prompts(examples, texts, told, hints)


def run_prompts(spark: SparkSession, a: argparse.Namespace) -> int:
    _prompts(spark, a).write.mode("overwrite").json(a.output)
    return 0


def run_infer(spark: SparkSession, a: argparse.Namespace) -> int:
    module, _, name = a.generator.partition(":")
    load = getattr(importlib.import_module(module), name)
    asked = _prompts(spark, a).select(F.col("example_idx").alias("id"), "messages")
    return _score(spark, a, generation.generate(asked, a.answers_output, a.model, load, a.batch_size))


def run_score(spark: SparkSession, a: argparse.Namespace) -> int:
    return _score(spark, a, spark.read.schema("id long, answer string").json(a.answers))


def _score(spark: SparkSession, a: argparse.Namespace, answers) -> int:
    store, rows = _examples(spark, a)
    gold = files.head(store.load_gold(a.dataset, a.split), a.limit)
    if (n := gold.count()) != len(rows):
        raise ValueError(f"Example count ({len(rows)}) != gold count ({n})")
    pairs = gold.withColumnRenamed("idx", "id").join(answers, "id", "left").select("id", "db_id", F.col("sql").alias("gold_sql"), F.coalesce(prediction(F.col("answer")), F.lit("")).alias("pred_sql"), F.col("answer").alias("raw_output")).cache()
    details = exact.score_pairs(pairs, exact.Databases(list(store.load_tables().values()))).cache()
    lines = pairs.orderBy("id").collect()
    files.write_lines(spark, a.predictions_output, [r["pred_sql"] for r in lines])
    files.write_lines(spark, a.gold_output, [f"{r['gold_sql']}\t{r['db_id']}" for r in lines])
    scores = [r.asDict() for r in exact.level_scores(details).collect()]
    whole = next(s for s in scores if s["hardness"] == "all")
    given = files.hints(spark, a.hints_input, _frame(spark, rows)).withColumnRenamed("example_idx", "id") if a.hints_input else None
    examples = spark.createDataFrame([(i, r.get("id"), r.get("question_vi", r.get("question", ""))) for i, r in enumerate(rows)], "id long, example_id string, question string").join(pairs.drop("db_id"), "id")
    examples = examples.join(given, "id", "left") if given is not None else examples.withColumn("hints", F.array().cast(f"array<{matching.HINT}>"))
    items = [r.asDict(recursive=True) for r in reports.match_report(examples, details).orderBy("id").collect()]
    for item in items:
        if item["parse_error"] is None:
            del item["parse_error"]
    with_hints = sum(bool(i["hints"]) for i in items)
    summary = {"count": whole["count"], "exact_match": whole["exact_match"], "model": a.model, "dataset": f"{a.dataset}_{a.split}", "timestamp": datetime.now().isoformat(), "augmentation": {"mode": "precomputed_hints" if a.hints_input else "none", "hints_input": a.hints_input, "examples_with_hints": with_hints}}
    files.write_json(spark, a.output, {"summary": summary, "by_difficulty": reports.difficulty_report(scores), "examples": items})
    print(reports.score_table(scores))
    return 0


def run_exec(spark: SparkSession, a: argparse.Namespace) -> int:
    beside = lambda given, name: given or str(PurePosixPath(a.predictions_input).parent / name)
    pred = [r["sql"] for r in files.predictions(spark, a.predictions_input).orderBy("idx").collect()]
    gold = [(r["sql"], r["db_id"]) for r in files.gold(spark, beside(a.gold_input, "gold.txt")).orderBy("idx").collect()]
    entries = {e["db_id"]: e for e in files.read_json(spark, f"{a.data}/tables.json")}
    dbs = exact.Databases(list(entries.values()))
    catalogs = {db: of_sqlite(spark, f"{a.sqlite_dir}/{db}/{db}.sqlite") if a.sqlite_dir else of_database(spark, db) for db in sorted({db for _, db in gold})}
    scores, details = execution.evaluate(spark, gold, pred, catalogs, dbs.keys, a.timeout_seconds, ordered=not a.multiset)
    files.write_json(spark, beside(a.exec_details_output, "exec_details.json"), details)
    em_path, em = beside(a.em_input, "eval_em_only.json"), None
    if files.exists(spark, em_path):
        try:
            em = files.read_json(spark, em_path).get("summary")
        except ValueError as e:
            print(f"WARN: failed to read EM summary from {em_path}: {e}")
    counts = {"matches": sum(d["exec_match"] for d in details), "errors": sum(d["error"] is not None for d in details), "timeouts": sum(d["timeout"] for d in details), "total": len(details)}
    summary = {"count": len(details), "execution_accuracy": scores["all"]["execution_accuracy"], "model": (em or {}).get("model", a.model), "dataset": (em or {}).get("dataset", a.dataset), "timestamp": datetime.now().isoformat(), "timeout_seconds": a.timeout_seconds, "compare": "multiset" if a.multiset else "ordered", "exec_stats": counts}
    summary |= {k: em[k] for k in ("exact_match", "augmentation", "database_descriptions") if em and em.get(k) is not None}
    files.write_json(spark, beside(a.output, "eval_ex.json"), {"summary": summary} | ({"em_summary": em} if em is not None else {}))
    print(f"Execution Accuracy (EX): {summary['execution_accuracy']:.2%}  {counts}")
    return 0


def run_hints(spark: SparkSession, a: argparse.Namespace) -> int:
    store, rows = _examples(spark, a)
    module, _, name = a.encoder.partition(":")
    load = getattr(importlib.import_module(module), name)
    s = schema.from_python(spark, list(store.load_tables().values()))
    ids = sorted({r["db_id"] for r in rows})
    targets = schema.rich_targets(Descriptions(spark, a.descriptions_dir, a.descriptions_file).rows(ids), s) if a.descriptions_dir else schema.targets(s)
    vectors = matching.encode_texts(targets, a.model, load, matching.document_prefix(a.model)).withColumnRenamed("text", "t")
    targets = targets.join(vectors, targets.text == vectors.t).drop("t")
    tagged = files.json_rows(spark, a.tagged, "index long, tagged array<struct<token: string, tag: string>>")
    examples = _frame(spark, rows).join(tagged.withColumnRenamed("index", "example_idx"), "example_idx")
    names = schema.schema_names(s)
    levels = sorted(set(a.thresholds))
    encode = lambda texts: matching.encode_texts(texts, a.model, load, matching.query_prefix(a.model))
    base = matching.augment(examples, names, targets, encode, levels[0]).cache()
    counted = matching.filter_counts(base.join(names, "db_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))))
    terms = matching.top_removed_stopwords(counted)
    questions = {i: r.get("question_vi", "") for i, r in enumerate(rows)}
    for t in levels:
        own = matching.at_thresholds(base, [t])
        folder = f"{a.output_root}/{a.split}_t{t:.2f}".replace(f"t{t:.2f}", f"t{t:.2f}".replace(".", "")) + a.output_suffix
        items = [{"index": r["example_idx"], "db_id": r["db_id"], "question_vi": questions[r["example_idx"]], "hints": [h.asDict() for h in r["hints"]]} for r in own.orderBy("example_idx").collect()]
        files.write_json(spark, f"{folder}/hints.json", items)
        files.write_json(spark, f"{folder}/augment_stats.json", stats.augment_stats(own, a.model, t, counted, terms).first().asDict(recursive=True))
    return 0


def _runs(spark: SparkSession, root: str):
    """(model, n, em, ex) of each run folder below root."""
    p, fs = files._fs(spark, root)
    rows = []
    for f in sorted((str(x.getPath()) for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []):
        for name, has_ex in (("eval_ex.json", True), ("eval_em_only.json", False)):
            if files.exists(spark, f"{f}/{name}"):
                s = files.read_json(spark, f"{f}/{name}").get("summary", {})
                rows.append((f.rsplit("/", 1)[-1], s.get("count", 0), s.get("exact_match"), s.get("execution_accuracy") if has_ex else None))
                break
    return spark.createDataFrame(rows, "model string, n long, em double, ex double")


def run_compare(spark: SparkSession, a: argparse.Namespace) -> int:
    base = _runs(spark, a.baseline)
    new = _runs(spark, a.augmented) if a.augmented else base
    rows = [r.asDict() for r in reports.delta_table(base, new).orderBy("model").collect()]
    print(reports.delta_text(rows))
    first, second = ("ex", "em") if a.primary == "execution_accuracy" else ("em", "ex")
    best = [r.asDict() for r in reports.best_run(new, first, second).collect()]
    if a.output:
        files.write_json(spark, a.output, {"primary_metric": a.primary, "best": best[0] if best else None, "rows": rows})
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    return {"prompts": run_prompts, "score": run_score, "infer": run_infer, "exec": run_exec, "hints": run_hints, "compare": run_compare}[a.mode](session(a.master), a)


if __name__ == "__main__":
    sys.exit(main())
