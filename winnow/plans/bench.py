"""Synthetic rules, percentiles and dataset manifests for measuring the compiler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lists import content_identity


def synthetic(spark: SparkSession, files: int, rules_per_file: int) -> DataFrame:
    """(file, rule_no, rule): a rule for every number, by arithmetic."""
    f, r = F.col("file"), F.col("rule_no")
    rows = spark.range(files * rules_per_file).select(F.floor(F.col("id") / rules_per_file).cast("long").alias("file"), (F.col("id") % rules_per_file).alias("rule_no"))
    return rows.withColumn("rule", F.format_string("||synthetic-%03d-%05d-%03d-%03d.example^", f, r, (37 * f + 17 * r) % 997, (53 * f + 29 * r) % 991))


def percentiles(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group least, most, p50 (interpolated) and p95 (nearest rank) of a column, six digits; nulls are left out."""
    # percentile_disc() is the nearest-rank value and needs no list of all values.
    out = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"))
    return out.select(group, *[F.round(c, 6).alias(c) for c in ("least", "most", "p50", "p95")])


def manifest(spark: SparkSession, folder: str, health: DataFrame) -> DataFrame:
    """The files of a folder joined to their source's health (filename, url, status); a file without one is an error."""
    files = content_identity(spark, folder)
    missing = [r.filename for r in files.join(health, "filename", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"no source health for {missing}")
    return files.join(health, "filename").select("filename", "url", "byte_size", "sha256", "status")


def manifest_errors(listed: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(filename, problem): listed but missing, there but not listed, or of another size or digest."""
    actual = content_identity(spark, folder).toDF("filename", "a_size", "a_sha")
    both = listed.select("filename", "byte_size", "sha256").join(actual, "filename", "full")
    problem = F.when(F.col("a_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("a_size") != F.col("byte_size"), "size").when(F.col("a_sha") != F.col("sha256"), "sha256")
    return both.select("filename", problem.alias("problem")).where("problem is not null")
