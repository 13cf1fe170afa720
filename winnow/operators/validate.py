"""Release gates: each finds rows (severity, code, message, details) that speak against a release."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.suffix import with_suffix
from ..functions.syntax import UNSUPPORTED, with_syntax
from ..functions.text import normalize_domain, strip
from ..sources.staging import staged
from .evidence import coverage, meets_scope

STATUSES = ("failed", "fallback_cache", "fresh_fetch", "stale_cache", "validated_cache")
DEGRADED = ("failed", "fallback_cache", "stale_cache")


@dataclass(frozen=True)
class Thresholds:
    """The numbers that decide about a release."""

    minimum_output_rules: int = 1_000_000
    source_failed_stale_minimum: int = 3
    source_fallback_stale_minimum: int = 8
    source_hard_ratio: float = 0.10
    previous_extreme_drop_ratio: float = 0.25
    previous_extreme_increase_ratio: float = 1.00
    previous_moderate_delta_ratio: float = 0.10
    previous_extreme_absolute_delta: int = 1_000_000


LIMITS = Thresholds()
MESSAGES = {
    "output_exception_rule": "an exception rule in the release",
    "output_invalid_syntax": "a rule of invalid syntax in the release",
    "output_url_path": "a rule with a URL path in the release",
    "output_unsupported_modifier": "a browser-only modifier in the release",
}


def scanned(lines: DataFrame) -> DataFrame:
    """The lines (line_no, line) of an artifact with their syntax; blank ones dropped, numbers kept."""
    return staged(with_syntax(lines.select("line_no", strip("line").alias("line"))), "scanned").where("line <> ''")


def output_findings(scan: DataFrame) -> DataFrame:
    """(line_no, line, code): a line can raise several."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("is_exception"), "output_exception_rule"),
            F.when(c("is_invalid"), "output_invalid_syntax"),
            F.when(c("has_url_path"), "output_url_path"),
            F.when(F.arrays_overlap("names", F.array(*map(F.lit, UNSUPPORTED))), "output_unsupported_modifier"),
        )
    )
    return scan.select("line_no", "line", F.explode(found).alias("code"))


def scan_counts(scan: DataFrame) -> DataFrame:
    c = F.col
    return scan.agg(
        F.count("*").alias("lines_scanned"),
        F.count_if("is_invalid").alias("invalid_rules"),
        F.count_if("has_url_path").alias("url_path_rules"),
        F.count_if(F.arrays_overlap("names", F.array(*map(F.lit, UNSUPPORTED)))).alias("unsupported_modifier_rules"),
        F.count_if(c("is_exception")).alias("exception_rules"),
    )


def blocked_domains(lines: DataFrame) -> DataFrame:
    """(domain, is_wildcard) that an artifact's lines (ord, line) block; modifiers are not looked at."""
    from .route import classify, route

    r = staged(route(classify(lines.select("ord", "line"))), "blocked").where("kind is not null and not is_exception")
    direct = r.where("line like '||%' and abp_domain <> ''").select(F.col("abp_domain").alias("domain"), F.col("abp_wildcard").alias("is_wildcard"))
    named = r.where("route in ('hosts', 'plain')").select(F.explode("domains").alias("domain"), F.lit(False).alias("is_wildcard"))
    return direct.unionByName(named).distinct()


def simple_canaries(canaries: DataFrame, blocked: DataFrame) -> DataFrame:
    """canaries (domain, ...) with blocked: itself or an ancestor is blocked, or any suffix of its labels is blocked as a wildcard."""
    d = with_suffix(canaries.withColumn("_d", normalize_domain("domain")), "_d")
    labels = F.split("_d", "[.]")
    plain = F.transform(F.concat(F.array("_d"), "parents"), lambda x: F.struct(x.alias("domain"), F.lit(False).alias("is_wildcard")))
    wild = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("domain"), F.lit(True).alias("is_wildcard")))
    probe = d.select(F.col("domain").alias("_canary"), F.explode(F.concat(plain, wild)).alias("k")).select("_canary", "k.*")
    hit = probe.join(blocked, ["domain", "is_wildcard"], "left_semi").select("_canary").distinct()
    return canaries.join(hit, canaries.domain == hit._canary, "left").withColumn("blocked", F.col("_canary").isNotNull()).drop("_canary")


def scoped_canaries(canaries: DataFrame, rules: DataFrame) -> DataFrame:
    """canaries (name, domain, expect, scope, gate) with matched, blocked and status, against the coverage of rules (ord, line)."""
    cover = coverage(rules)
    c = with_suffix(canaries.withColumn("_d", normalize_domain("domain")), "_d").withColumn("_id", F.xxhash64("name", "domain", "expect", "scope", "gate"))
    probe = c.withColumn("_key", F.explode(F.concat(F.array("_d"), "parents")))
    cover = cover.select("domain", "effect", F.col("scope").alias("c_scope"), "is_global", "modifier_names").withColumnRenamed("domain", "c_domain")
    hit = probe.select("_id", "_d", "parents", F.col("scope").alias("required"), "_key").join(cover, F.col("_key") == F.col("c_domain")).withColumnRenamed("c_domain", "domain").withColumnRenamed("c_scope", "scope")
    meets = lambda r: meets_scope(F.col("_d"), F.col("parents"), r)
    apex_allowed = F.col("required") == "wildcard_apex_allowed"
    block = F.when(apex_allowed, meets(F.lit("apex"))).otherwise(meets(F.col("required")))
    seen = hit.groupBy("_id").agg(F.bool_or(F.when(apex_allowed, meets(F.col("required")) | block).otherwise(meets(F.col("required")))).alias("matched"), F.bool_or(block).alias("blocked"))
    out = c.join(seen, "_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    passed = F.when(F.col("expect") == "blocked", F.col("blocked")).otherwise(~F.col("blocked"))
    return out.select(*canaries.columns, "matched", "blocked", F.when(passed, "passed").otherwise("failed").alias("status"))


def _coded(df: DataFrame, *rules: tuple, more: tuple = ()) -> DataFrame:
    """(severity, code, position), and more columns of df, for each of the rules (severity, code, condition) that holds for a row of df."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.lit(k).alias("position"))) for k, (sev, code, cond) in enumerate(rules)]))
    return df.select(*more, F.explode(found).alias("f")).select(*more, "f.*")


def source_limits(health: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """One row over sources (status): counts and the hard limits that they are held against."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    limit = lambda least: F.greatest(F.lit(least), F.ceil(F.col("source_count") * limits.source_hard_ratio).cast("int")).cast("long")
    out = health.agg(F.count("*").alias("source_count"), of("failed", "stale_cache").alias("failed_stale"), of("fallback_cache", "stale_cache").alias("fallback_stale"), of(*DEGRADED).alias("degraded"))
    return out.withColumn("failed_stale_limit", limit(limits.source_failed_stale_minimum)).withColumn("fallback_stale_limit", limit(limits.source_fallback_stale_minimum))


def source_findings(limited: DataFrame) -> DataFrame:
    """(severity, code, position) about source_limits(): both hard limits are looked at, and only if neither is broken does a warning count."""
    a, b = F.col("failed_stale") > F.col("failed_stale_limit"), F.col("fallback_stale") > F.col("fallback_stale_limit")
    return _coded(limited, ("error", "source_health_catastrophic_failed_stale", a), ("error", "source_health_catastrophic_fallback_stale", b), ("warning", "source_health_degraded", ~a & ~b & (F.col("degraded") > 0)))


def previous_findings(counts: DataFrame, limits: Thresholds = LIMITS, more: tuple = ()) -> DataFrame:
    """(severity, code, position), and more columns of counts, about the change in the number of rules; counts has current_count and previous_count (null: there is no previous release)."""
    now, before = F.col("current_count"), F.col("previous_count")
    some, delta = before > 0, F.abs(now - before)
    drop = some & (now < before) & (delta / before > limits.previous_extreme_drop_ratio)
    rise = some & (now >= before) & (delta / before > limits.previous_extreme_increase_ratio)
    far = some & (delta > limits.previous_extreme_absolute_delta)
    moderate = some & ~drop & ~rise & ~far & (delta / before > limits.previous_moderate_delta_ratio)
    return _coded(
        counts,
        ("warning", "previous_output_unavailable", before.isNull()),
        ("warning", "previous_output_empty", before <= 0),
        ("error", "previous_output_extreme_drop", drop),
        ("error", "previous_output_extreme_increase", rise),
        ("error", "previous_output_extreme_absolute_delta", far),
        ("warning", "previous_output_moderate_delta", moderate),
        more=more,
    )


def count_findings(counts: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """(severity, code, position) about the number of rules; counts has scanned and reported (null: no report names one)."""
    return _coded(counts, ("error", "pipeline_output_count_mismatch", F.col("reported") != F.col("scanned")), ("error", "output_below_minimum_count", F.col("scanned") < limits.minimum_output_rules))


def percentile_row(values: list[float]) -> dict:
    """min, max, median (interpolated) and p95 (nearest rank), six digits; no values give zeros."""
    v = sorted(values) or [0.0]
    n = len(v)
    mid = v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2
    return {"min_seconds": round(v[0], 6), "max_seconds": round(v[-1], 6), "p50_seconds": round(mid, 6), "p95_seconds": round(v[max(0, math.ceil(0.95 * n) - 1)], 6)}
