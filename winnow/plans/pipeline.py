"""From a folder of raw lists to one merged file with its reports."""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..functions.suffix import list_digest
from ..operators.clean import clean, clean_stages, clean_stats
from ..sources.health import health_summary, save_json
from ..sources.lists import count_files, read_lists, write_lines
from ..sources.staging import staged
from .compile import EFFECTS, compile_rules, stage_summaries

SCHEMA_VERSION = 4
#: Counters of the cleaner by the names that the statistics have.
RENAMED = {"comment_removed": "comments_removed", "unsupported_modifier_removed": "unsupported_removed"}
USAGE = (("user_cpu_seconds", "ru_utime"), ("system_cpu_seconds", "ru_stime"), ("resource_ru_maxrss", "ru_maxrss"), ("minor_page_faults", "ru_minflt"), ("major_page_faults", "ru_majflt"), ("voluntary_context_switches", "ru_nvcsw"), ("involuntary_context_switches", "ru_nivcsw"))


@dataclass(frozen=True)
class Run:
    """What a run counted, and what it took."""

    statistics: dict
    cardinalities: dict
    profile: dict
    seconds: float


def resource_usage(children: bool = True):
    """What this process, or its ended children, used so far; None where that can't be asked."""
    try:
        import resource
    except ImportError:
        return None
    return resource.getrusage(resource.RUSAGE_CHILDREN if children else resource.RUSAGE_SELF)


def usage_delta(before, after) -> dict:
    """What was used between two observations, 0 at least; nothing if one is missing."""
    there = before is not None and after is not None
    difference = lambda field: max(0, getattr(after, field) - getattr(before, field)) if there else None
    return {"available": there, "platform": sys.platform, **{name: round(difference(field), 6) if there and name.endswith("seconds") else difference(field) for name, field in USAGE}}


def memory() -> dict:
    own, jvm = resource_usage(children=False), None
    return {"tracemalloc_current_bytes": jvm, "tracemalloc_peak_bytes": jvm, "resource_ru_maxrss": int(own.ru_maxrss) if own else None}


def semantics(stats: dict) -> dict:
    """The nested view of the counters about effects and promotion."""
    return {
        "rule_effect_counts": {e: int(stats.get(f"rule_effect_{e}") or 0) for e in EFFECTS},
        "compression_policy": {"hosts_plain_promoted_to_abp": int(stats.get("compression_policy_broadened") or 0), "regex_preserved_no_pruning": int(stats.get("regex_preserved_no_pruning") or 0)},
    }


def _nothing(spark: SparkSession) -> DataFrame:
    """The lines of no file."""
    fields = [T.StructField("file_idx", T.IntegerType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("had_newline", T.BooleanType())]
    return spark.createDataFrame([], T.StructType(fields))


def _health(path: str | None) -> dict:
    """health_summary() of a report; one that can't be read is as if it weren't there."""
    try:
        with open(path or "", encoding="utf-8") as f:
            report = json.load(f)
    except (OSError, ValueError):
        report = None
    return health_summary(report if isinstance(report, dict) else None, path)


def process_files_with_profile(spark: SparkSession, folder: str, output: str, proof_path: str | None = None, sample_cap: int = 25, health_path: str | None = None) -> Run:
    """Clean and merge the *.txt lists of a folder, which may have none, into output."""
    began = time.time()
    files, raw_bytes = count_files(spark, folder)
    before = resource_usage()
    raw = read_lists(spark, folder) if files else _nothing(spark)
    cleaned = staged(clean(raw.withColumn("ord", F.struct("file_idx", "line_no")), "had_newline").select("ord", "file_name", "line", "discard_reason", "was_trimmed"), "spool")
    clean_seconds, used = time.time() - began, usage_delta(before, resource_usage())
    compiling = time.time()
    done = compile_rules(cleaned.where("line is not null"))
    written = write_lines(done.ordered(), output)
    counted = {RENAMED.get(k, k): int(v or 0) for k, v in {**clean_stats(cleaned).first().asDict(), **done.stats().first().asDict()}.items()}
    cardinalities = {k: int(v or 0) for k, v in done.cardinalities().first().asDict().items()}
    compile_seconds = time.time() - compiling
    if proof_path:
        from ..operators.proof import capped_report, decisions

        save_json(proof_path, capped_report(staged(decisions(done), "decisions"), sample_cap))
    profile = {
        "worker_count": spark.sparkContext.defaultParallelism,
        "stage_durations_seconds": {"clean_seconds": round(clean_seconds, 6), "compile_seconds": round(compile_seconds, 6)},
        "byte_sizes": {"raw_input_bytes": raw_bytes, "output_bytes": os.path.getsize(output) if os.path.exists(output) else 0},
        "compiler_cardinalities": cardinalities,
        "memory": memory(),
        "child_resources": used,
        "source_health": _health(health_path),
        "suffix_list_sha256": list_digest(spark),
    }
    return Run({"files_processed": files, **counted, "lines_output": written}, cardinalities, profile, round(time.time() - began, 3))


def report(run: Run) -> dict:
    """The versioned statistics of a run."""
    return {
        "schema_version": SCHEMA_VERSION,
        "version": __version__,
        "timestamp": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "execution_time_seconds": run.seconds,
        "statistics": run.statistics,
        "cardinalities": run.cardinalities,
        "stage_summaries": {"cleaner": clean_stages({old: run.statistics.get(new) for old, new in RENAMED.items()} | run.statistics), "compiler": stage_summaries(run.statistics, run.cardinalities)},
        "semantics": semantics(run.statistics),
        "runtime_profile": run.profile,
    }


def process_files(spark: SparkSession, folder: str, output: str, stats_path: str | None = None, proof_path: str | None = None, sample_cap: int = 25, health_path: str | None = None) -> dict:
    """process_files_with_profile() as a report, which stats_path gets as well."""
    out = report(process_files_with_profile(spark, folder, output, proof_path, sample_cap, health_path))
    if stats_path:
        save_json(stats_path, out)
    return out


def summary_text(report: dict) -> str:
    s = report["statistics"]
    raw, out = max(1, s["lines_raw"]), s["lines_output"]
    rows = [f"{k.replace('_', ' ')}: {v}" for k, v in sorted(s.items())]
    return "\n".join([f"{s['lines_raw']} lines in {s['files_processed']} files, {out} rules ({100 * (1 - out / raw):.1f} % fewer)", *rows])
