"""python -m winnow: pipeline, clean, compile, fetch, validate, freeze, run-frozen, run-synthetic and profile."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("winnow").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _text(spark: SparkSession, path: str):
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("at", "raw")).select((F.col("at") + 1).cast("long").alias("ord"), "raw")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("winnow")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, about: str):
        p = sub.add_parser(name, help=about)
        for flags, settings in options:
            p.add_argument(flags, **settings)

    need = lambda name, **kw: (name, {"required": True, **kw})
    may = lambda name, **kw: (name, kw)
    command("pipeline", may("input"), may("output"), may("--json-stats"), may("--coverage-proof"), may("--source-health-report"), about="merge the lists of a folder")
    command("clean", may("input"), may("output", nargs="?", help="without it, the input is replaced"), about="clean one list")
    command("compile", may("input"), may("output"), about="compile one cleaned list")
    command("fetch", need("--sources"), need("--outdir"), need("--cache"), may("--concurrency", type=int, default=8), may("--timeout", type=float, default=30), may("--retries", type=int, default=3), may("--health-report"), about="fetch sources")
    command("validate", need("--source-health"), need("--pipeline-stats"), need("--output"), need("--canaries"), may("--previous-output"), need("--summary-json"), need("--summary-md"), may("--evidence-json"), may("--minimum-output-rules", type=int, default=1_000_000), about="decide about a release")
    command("freeze", need("--input-dir"), need("--source-health-report"), need("--dataset-id"), may("--root", default="reports/benchmarks"), about="freeze lists as a dataset")
    command("run-frozen", need("--manifest"), may("--iterations", type=int, default=1), need("--report"), about="time runs over a frozen dataset")
    command("run-synthetic", may("--dataset-id", default="synthetic-smoke"), may("--files", type=int, default=2), may("--rules-per-file", type=int, default=100), may("--iterations", type=int, default=1), need("--report"), may("--root", default="reports/benchmarks"), about="time runs over synthetic lists")
    command("profile", may("input"), need("--run-id"), may("--report-dir", default="reports/profiles"), may("--pstats-limit", type=int, default=40), about="profile one run")
    return parser


def _fetch(spark: SparkSession, args) -> int:
    from .sources import health, lists

    urls = [r.url for r in lists.read_catalog(spark, args.sources).orderBy("line_no").collect()]
    if not urls:
        print("no sources", file=sys.stderr)
        return 1
    results = health.fetch_all(urls, args.outdir, args.cache, args.concurrency, timeout=args.timeout, tries=args.retries)
    if args.health_report:
        health.save_json(args.health_report, health.health_report(spark, results, args.outdir, args.cache))
    failed = [r for r in results if not r["success"]]
    print(f"{len(urls) - len(failed)} of {len(urls)} sources, {sum(r['changed'] for r in results)} new", *(f"failed: {r['url']}: {r['error']}" for r in failed), sep="\n")
    return 0


def _validate(spark: SparkSession, args) -> int:
    from .operators.validate import Thresholds
    from .plans.release import validate_release

    paths = {k: getattr(args, k) for k in ("source_health", "pipeline_stats", "output", "canaries", "previous_output", "summary_json", "summary_md", "evidence_json")}
    done = validate_release(spark, **paths, limits=Thresholds(minimum_output_rules=args.minimum_output_rules))
    print(f"release {done['status']}: {len(done['errors'])} errors, {len(done['warnings'])} warnings")
    return int(done["status"] == "failed")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = _session()
    from .operators.clean import clean
    from .plans import reports
    from .plans.compile import compile_rules
    from .plans.pipeline import process_files, summary_text
    from .sources import lists
    from .sources.health import save_json
    from .sources.staging import staged

    if args.command == "pipeline":
        print(summary_text(process_files(spark, args.input, args.output, args.json_stats, args.coverage_proof, health_path=args.source_health_report)))
    elif args.command == "clean":
        lists.write_lines(staged(clean(_text(spark, args.input)), "clean").where("line is not null").orderBy("ord"), args.output or args.input)
    elif args.command == "compile":
        lists.write_lines(compile_rules(_text(spark, args.input).withColumnRenamed("raw", "line")).ordered(), args.output)
    elif args.command == "fetch":
        return _fetch(spark, args)
    elif args.command == "validate":
        return _validate(spark, args)
    elif args.command == "freeze":
        print(reports.freeze_from_report(args.input_dir, args.source_health_report, args.root, args.dataset_id))
    elif args.command == "profile":
        print(os.path.join(args.report_dir, args.run_id, "profile.json"), reports.profile_run(spark, args.input, args.report_dir, args.run_id, args.pstats_limit)["elapsed_seconds"])
    else:
        frozen = args.command == "run-frozen"
        done = reports.timed_runs(spark, args.manifest, args.iterations) if frozen else reports.synthetic_runs(spark, args.root, args.dataset_id, args.files, args.rules_per_file, args.iterations)
        save_json(args.report, done)
        print(done["summary"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
