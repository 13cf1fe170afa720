"""Frozen datasets and timed or profiled runs over them; their reports are read and written on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.validate import percentile_row
from ..sources.health import CHUNK, by_filename, save_json, save_text
from .bench import synthetic

def safe_name(name: str) -> str:
    """A *.txt file name without any path, or an error."""
    if os.path.basename(name) != name or name in ("", ".", "..") or not name.endswith(".txt"):
        raise ValueError(f"unsafe file name {name!r}")
    return name


def safe_folder(root: str, dataset_id: str) -> str:
    """root/dataset_id, which neither leaves root nor passes a symbolic link."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", dataset_id) or dataset_id in (".", ".."):
        raise ValueError("a dataset's name has letters, digits, dots, dashes and underscores only")
    path = os.path.join(root, dataset_id)
    if os.path.islink(path) or os.path.islink(root):
        raise ValueError("a dataset's folder must not be a symbolic link")
    return path


def _identity(path: str) -> tuple[int, str]:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return os.path.getsize(path), h.hexdigest()


def freeze_dataset(folder: str, sources: dict[str, dict], root: str, dataset_id: str) -> str:
    """Copy the lists of a folder to root/dataset_id/raw with a manifest; sources has the health of each by file name. Returns the manifest's path."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".txt"))
    if not names:
        raise ValueError("no lists to freeze")
    target = safe_folder(root, dataset_id)
    raw = os.path.join(target, "raw")
    os.makedirs(raw, exist_ok=True)
    rows = []
    for name in map(safe_name, names):
        if name not in sources:
            raise ValueError(f"no source health for {name}")
        before = _identity(os.path.join(folder, name))
        shutil.copyfile(os.path.join(folder, name), os.path.join(raw, name + ".tmp"))
        os.replace(os.path.join(raw, name + ".tmp"), os.path.join(raw, name))
        if _identity(os.path.join(raw, name)) != before:
            raise ValueError(f"{name} changed while it was copied")
        rows.append({"url": sources[name]["url"], "filename": name, "byte_size": before[0], "sha256": before[1], "source_health_status": sources[name]["status"]})
    if extra := sorted(set(os.listdir(raw)) - set(names)):
        raise ValueError(f"unexpected file {extra[0]}")
    path = os.path.join(target, "manifest.json")
    save_json(path, {"schema_version": 1, "dataset_id": dataset_id, "raw_dir": "raw", "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "sources": rows})
    return path


def checked_manifest(path: str) -> dict:
    """A manifest whose files are all there, no others, with the sizes and digests it names."""
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    if manifest.get("schema_version") != 1:
        raise ValueError("manifest version")
    raw = os.path.join(os.path.dirname(path), manifest["raw_dir"])
    listed = {safe_name(s["filename"]): s for s in manifest["sources"]}
    if set(listed) != {n for n in os.listdir(raw) if n.endswith(".txt")}:
        raise ValueError("the files are not those of the manifest")
    for name, s in listed.items():
        if _identity(os.path.join(raw, name)) != (s["byte_size"], s["sha256"]):
            raise ValueError(f"{name} is not the file of the manifest")
    return manifest


def freeze_from_report(folder: str, health_path: str, root: str, dataset_id: str) -> str:
    """freeze_dataset() with the sources of a health report."""
    with open(health_path, encoding="utf-8") as f:
        report = json.load(f)
    return freeze_dataset(folder, by_filename(report), root, dataset_id)


def _observed(spark: SparkSession, raw: str, out: str) -> dict:
    from .pipeline import process_files_with_profile

    began = time.perf_counter()
    run = process_files_with_profile(spark, raw, out)
    size, digest = _identity(out)
    return {"elapsed_seconds": round(time.perf_counter() - began, 6), "lines_output": run.statistics["lines_output"], "output_bytes": size, "output_sha256": digest, "runtime_profile": run.profile}


def _runs(spark: SparkSession, dataset_id: str, iterations: int, raw, folder: str) -> dict:
    if iterations < 1:
        raise ValueError("at least one iteration")
    seen = [{"iteration": k, **_observed(spark, raw(), os.path.join(folder, f"run-{k}.txt"))} for k in range(1, iterations + 1)]
    return {
        "schema_version": 1,
        "version": __version__,
        "dataset_id": dataset_id,
        "iterations": iterations,
        "observed": seen,
        "summary": percentile_row([r["elapsed_seconds"] for r in seen]),
        "rules": seen[-1]["lines_output"],
        "deterministic": len({r["output_sha256"] for r in seen}) == 1,
    }


def timed_runs(spark: SparkSession, manifest_path: str, iterations: int = 3) -> dict:
    """Run the pipeline over a frozen dataset several times, checking it before each run."""
    base = os.path.dirname(manifest_path)
    raw = lambda: os.path.join(base, checked_manifest(manifest_path)["raw_dir"])
    return _runs(spark, checked_manifest(manifest_path)["dataset_id"], iterations, raw, base)


def synthetic_runs(spark: SparkSession, root: str, dataset_id: str, files: int, rules_per_file: int, iterations: int) -> dict:
    """The same over synthetic lists, which are written first, a file at a time."""
    if files < 1 or rules_per_file < 1:
        raise ValueError("at least one file and one rule")
    target = safe_folder(root, dataset_id)
    raw = os.path.join(target, "raw")
    os.makedirs(raw, exist_ok=True)
    rows = synthetic(spark, files, rules_per_file).orderBy("file", "rule_no").toLocalIterator()
    for k in range(files):
        save_text(os.path.join(raw, f"synthetic-{k:03d}.txt"), "".join(next(rows)["rule"] + "\n" for _ in range(rules_per_file)))
    return _runs(spark, dataset_id, iterations, lambda: raw, target)


def profile_run(spark: SparkSession, folder: str, root: str, run_id: str, limit: int = 40) -> dict:
    """Run the pipeline with the driver's profiler; writes the statistics of its calls, two summaries of them, and a report. Returns the report.

    Tasks run in executors; what they took is in Spark's event log, which spark.eventLog.dir names.
    """
    import cProfile
    import io
    import pstats

    from .pipeline import process_files_with_profile

    if limit < 1:
        raise ValueError("at least one row")
    target = safe_folder(root, run_id)
    os.makedirs(target, exist_ok=True)
    at = lambda name: os.path.join(target, name)
    profiler = cProfile.Profile()
    began = time.perf_counter()
    run = profiler.runcall(process_files_with_profile, spark, folder, at("merged.txt"), at("coverage-proof.json"))
    took = time.perf_counter() - began
    profiler.dump_stats(at("driver.pstats"))
    for order in ("cumulative", "tottime"):
        text = io.StringIO()
        pstats.Stats(profiler, stream=text).sort_stats(order).print_stats(limit)
        save_text(at(f"pstats-{order}.txt"), text.getvalue())
    made = {"pstats": "driver.pstats", "cumulative": "pstats-cumulative.txt", "tottime": "pstats-tottime.txt", "output": "merged.txt", "coverage_proof": "coverage-proof.json"}
    out = {"schema_version": 1, "version": __version__, "run_id": run_id, "elapsed_seconds": round(took, 6), "statistics": run.statistics, "runtime_profile": run.profile, "artifacts": made, "event_log": spark.conf.get("spark.eventLog.dir", None)}
    save_json(at("profile.json"), out)
    return out


def write_synthetic(spark: SparkSession, folder: str, files: int, rules_per_file: int) -> None:
    """Synthetic lists as text files, one folder for each file number, for runs at any size."""
    synthetic(spark, files, rules_per_file).select(F.format_string("synthetic-%03d", "file").alias("list"), F.col("rule").alias("value")).repartition(files, "list").write.partitionBy("list").mode("overwrite").text(folder)
