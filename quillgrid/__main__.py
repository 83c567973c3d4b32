"""Command line: sample, evaluate, analyze, models."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from quillgrid.operators import evaluation, models, reports
from quillgrid.operators import external as E
from quillgrid.session import kept, session
from quillgrid.sources import readers, writers

TIERS = list(readers.TIER_FILES)


def _named(path: str):
    """An object named module:attribute."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _cache(spark, path: str, schema: str):
    """The rows of a cache, or None before the first run. They are kept, as the run adds files to the folder."""
    try:
        return kept(spark.read.schema(schema).json(path))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _companies(spark, args) -> list[tuple[str, str]]:
    if args.company:
        return [tuple(c.split("/", 1)) for c in args.company]
    base, _ = readers.TIER_FILES[args.difficulty]
    return [tuple(r) for r in readers.companies(spark, args.data_root, base).collect()]


def _aggregates(spark, folder: str) -> None:
    """What the aggregate files of a folder say by tier, type and company, also those of other programs; files that do not parse are named."""
    try:
        bad, files = readers.bad_aggregates(spark, folder), readers.aggregates(spark, folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return
    for r in bad.orderBy("file").limit(100).collect():
        print(f"not read: {r['file']}")
    found = kept(reports.long_aggregates(files))
    for axis in ("all", "difficulty", "question_type", "company"):
        print(f"aggregates by {axis}")
        reports.breakdown(found, axis, ["exact_match", "token_f1", "num_exact", "rouge_l"]).show(200, False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("sample", "evaluate"):
        c = commands.add_parser(name)
        c.add_argument("--data-root", default="dataset")
        c.add_argument("--difficulty", choices=TIERS, default="easy")
        c.add_argument("--company", action="append", help="sector/company; all by default")
        c.add_argument("--max-per-company", type=int)
    c.add_argument("--regime", choices=E.REGIMES, default="zero_shot")
    c.add_argument("--model", default="stub")
    c.add_argument("--backend", help="module:factory that answers prompts; a stub by default")
    c.add_argument("--judge", help="module:factory that judges numbers")
    c.add_argument("--table-format", choices=("html", "markdown", "linearized"), default="html")
    c.add_argument("--output-dir", default="results")
    c = commands.add_parser("analyze")
    c.add_argument("--results-dir", default="results")
    c.add_argument("--errors", action="store_true")
    c.add_argument("--failures", action="store_true")
    c.add_argument("--compare", action="store_true")
    c = commands.add_parser("models")
    c.add_argument("file", help="JSON file of endpoints")
    args = parser.parse_args(argv)
    if args.command == "models":
        for name, m in models.endpoints(args.file).items():
            print(f"{name}: {m.shown} ({m.model} at {m.address})")
        return
    spark = session(app="quillgrid")
    if args.command == "analyze":
        _aggregates(spark, f"{args.results_dir}/aggregates")
        rows = readers.details(spark, f"{args.results_dir}/eval_results/*", "question_id string, exact_match int, token_f1 double, rouge_l double, num_exact int, num_f1 double, entailment_ratio double, failed boolean, error string")
        rows = rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("r", reports.run_name(F.concat("run", F.lit(".json")))).select("*", "r.model", "r.tier", "r.regime")
        metrics = ["exact_match", "token_f1", "rouge_l", "num_exact", "num_f1", "entailment_ratio"]
        reports.summary(rows, ["model", "tier", "regime"], metrics).orderBy("model", reports.in_order(F.col("tier"), reports.TIERS), "regime").show(200, False)
        if args.compare:
            reports.regime_delta(rows, "model", "tier", "regime", "token_f1").show(200, False)
        if args.errors:
            reports.error_summary(rows, "run", "error", "question_id").show(200, False)
        if args.failures:
            reports.near_misses(rows, "question_id").show(10, False)
        return
    questions = readers.sample(spark, args.data_root, _companies(spark, args), args.difficulty, args.max_per_company)
    if args.command == "sample":
        questions.groupBy("company", "question_type").count().orderBy("company", F.desc("count"), "question_type").show(200, False)
        return
    tag = models.run_tag(args.model, args.difficulty, args.regime, args.table_format)
    base, _ = readers.TIER_FILES[args.difficulty]
    try:
        chunks = readers.chunks(spark, f"{args.data_root}/{base}/*/*/*/chunks.jsonl").cache()
    except Exception as e:  # no chunk files: the evidence is the context
        if "PATH_NOT_FOUND" not in str(e):
            raise
        chunks = None
    cache_path, judge_path = f"{args.output_dir}/generations/{tag}", f"{args.output_dir}/judgements"
    run = evaluation.evaluate(
        questions,
        _named(args.backend) if args.backend else E.Stub(),
        args.regime,
        chunks,
        args.table_format,
        _cache(spark, cache_path, evaluation.EMPTY),
        _named(args.judge) if args.judge else None,
        _cache(spark, judge_path, f"_key string, {E.ANSWER}"),
    )
    writers.records(run.generations, cache_path)
    if run.judgements is not None:
        writers.records(run.judgements, judge_path)
    writers.records(run.scored.drop("anchors", "_prompt", "context"), f"{args.output_dir}/eval_results/{tag}", "overwrite")
    writers.text(writers.aggregate_json(run.card), f"{args.output_dir}/aggregates/{tag}.json", spark)
    writers.records(run.intervals, f"{args.output_dir}/intervals/{tag}", "overwrite")
    run.card.show(100, False)


if __name__ == "__main__":
    main()
