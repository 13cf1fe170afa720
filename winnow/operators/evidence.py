"""Evidence about a release: what its rules cover, and how its members changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.effects import LOCAL_NAMES
from ..functions.modifiers import scope_columns, signature_parts
from ..functions.syntax import PLAIN_DOMAIN
from ..functions.text import normalize_domain, strip
from .route import classify, route

SAMPLE_CAP = 25
SCOPES = ("unscoped_global", "apex", "subdomain", "apex_and_subdomains", "exact_host", "wildcard_child", "wildcard_apex_allowed")


def coverage(rules: DataFrame) -> DataFrame:
    """(ord, raw_rule, domain, syntax_kind, effect, scope, is_global, is_exception, is_wildcard, modifier_names, modifier_signature, notes) of rules (ord, line); a hosts line gives one row for each name.

    Stage the rules first: the result is a chain of expressions over the line.
    """
    from ..sources.staging import staged

    r = staged(route(classify(rules.select("ord", "line"))), "coverage")
    r = r.where("kind is not null and not is_invalid").withColumns(scope_columns(F.col("mods")))
    c = F.col
    effect = F.when(c("effect") == "block", "block").when(c("effect") == "exception", "allow").otherwise("diagnostic")
    direct = r.where("kind = 'abp' and abp_domain <> ''").withColumn("e", effect)
    scope = F.when(c("abp_wildcard"), "wildcard_child").when((c("e") == "diagnostic") & (c("scope") != ""), c("scope")).otherwise("apex_and_subdomains")
    common = ("ord", c("line").alias("raw_rule"))
    tail = (F.array_sort("mod_names").alias("modifier_names"), signature_parts(c("mods")).alias("modifier_signature"), F.filter(F.split("reason", ";"), lambda x: x != "").alias("notes"))
    is_global = (c("e") == "block") & ~c("abp_wildcard") & ~c("is_exception") & (F.size("mod_names") == 0) & ~c("uncertain") & c("m_none")
    one = direct.select(*common, c("abp_domain").alias("domain"), c("kind").alias("syntax_kind"), c("e").alias("effect"), scope.alias("scope"), is_global.alias("is_global"), "is_exception", c("abp_wildcard").alias("is_wildcard"), *tail)
    plain = (c("kind") == "plain_domain") & c("line").rlike(PLAIN_DOMAIN) & ~normalize_domain("line").isin(*LOCAL_NAMES)
    named = r.withColumn("ds", F.when(c("kind") == "hosts", c("domains")).when(plain, F.array(normalize_domain("line")))).select("*", F.explode("ds").alias("d"))
    two = named.select(*common, c("d").alias("domain"), c("kind").alias("syntax_kind"), F.lit("block").alias("effect"), F.lit("exact_host").alias("scope"), F.lit(False).alias("is_global"), F.lit(False).alias("is_exception"), F.lit(False).alias("is_wildcard"), F.array().cast("array<string>").alias("modifier_names"), F.array().cast(r.select(tail[1]).schema["modifier_signature"].dataType).alias("modifier_signature"), tail[2])
    return one.unionByName(two)


def in_report_order(covered: DataFrame) -> DataFrame:
    """coverage() rows by domain, rule and scope."""
    return covered.orderBy("domain", "raw_rule", "scope")


def coverage_sample(covered: DataFrame, cap: int = SAMPLE_CAP, whole: bool = False) -> list[dict]:
    """cap records for a report, in report order: the first of the artifact, or, with whole, the first of that order."""
    if cap < 1:
        raise ValueError("the cap must be at least 1")
    first = in_report_order(covered).limit(cap) if whole else in_report_order(covered.orderBy("ord").limit(cap))
    names = [c for c in covered.columns if c != "ord"]
    return [{c: [[m["name"], m["negated"], m["given"], [[v["value"], v["negated"]] for v in m["values"]], m["uncertain"], m["raw"]] for m in r[c]] if c == "modifier_signature" else r[c] for c in names} for r in first.select(*names).collect()]


def coverage_summary(covered: DataFrame) -> DataFrame:
    return covered.groupBy("effect", "scope").agg(F.count("*").alias("n"))


def meets_scope(target: Column, parents: Column, required: Column) -> Column:
    """Whether a coverage row (columns of coverage()) alone satisfies a required scope for a target domain with its ancestors."""
    c = F.col
    bare = (c("effect") == "block") & (F.size("modifier_names") == 0)
    same, below = target == c("domain"), F.array_contains(parents, c("domain"))
    wide = bare & (c("scope") == "apex_and_subdomains") & c("is_global")
    return (
        F.when((target == "") | (c("domain") == ""), False)
        .when(required == "wildcard_apex_allowed", bare & (c("scope") == "wildcard_child") & same)
        .when(required == "exact_host", bare & (c("scope") == "exact_host") & same)
        .when(required == "wildcard_child", bare & (c("scope") == "wildcard_child") & below)
        .when(required == "unscoped_global", wide & (same | below))
        .when(required.isin("apex", "apex_and_subdomains"), wide & same)
        .when(required == "subdomain", wide & below)
        .otherwise(False)
    )


def membership(lines: DataFrame) -> DataFrame:
    """(line): stripped, not empty, each once."""
    return lines.select(strip("line").alias("line")).where("line <> ''").distinct()


def added(current: DataFrame, previous: DataFrame) -> DataFrame:
    return membership(current).join(membership(previous), "line", "left_anti")


def churn(current: DataFrame, previous: DataFrame, cap: int = SAMPLE_CAP) -> dict:
    """Counts, fingerprints and the first cap names, in order, of what was added and removed."""
    if cap < 1:
        raise ValueError("the cap must be at least 1")
    sides = {"current": membership(current), "previous": membership(previous), "added": added(current, previous), "removed": added(previous, current)}
    out: dict = {}
    for name, lines in sides.items():
        row = membership_fingerprint(lines).first()
        out[f"{name}_count"], out[f"{name}_fingerprint"] = row.n, row.fingerprint
    return out | {f"{name}_samples": [r.line for r in sides[name].orderBy("line").limit(cap).collect()] for name in ("added", "removed")}


def membership_fingerprint(lines: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted distinct lines as a JSON array. All lines come together in one row, so this is for release artifacts, not raw input."""
    return membership(lines).agg(F.sha2(F.to_json(F.array_sort(F.collect_set("line"))), 256).alias("fingerprint"), F.count("*").alias("n"))
