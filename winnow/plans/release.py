"""Release validation: all gates on one artifact, their findings as a report for machines and one for people, and the evidence beside it."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.text import strip
from ..operators import evidence
from ..operators.proof import canonical
from ..operators.validate import DEGRADED, LIMITS, MESSAGES, STATUSES, Thresholds, blocked_domains, count_findings, output_findings, previous_findings, scan_counts, scanned, scoped_canaries, simple_canaries, source_findings
from ..sources.health import save_json, save_text
from ..sources.lists import read_artifact

STATS_VERSION, HEALTH_VERSION, CANARY_VERSIONS = 4, 1, (1, 2)
EXPECTATIONS, GATES, DEFAULT_GATE = ("allowed", "blocked"), ("diagnostic", "hard"), "diagnostic"
CANARY_FIELDS = ("domain", "expect", "gate", "name", "scope")
DETAILED = ("pipeline_stats_invalid", "pipeline_statistics_invalid", "pipeline_output_count_missing", "pipeline_output_count_invalid", "pipeline_output_count_mismatch")


def finding(code: str, message: str, **details) -> dict:
    return {"code": code, "message": message} | ({"details": details} if details else {})


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_stats(path: str) -> tuple[dict, list[dict]]:
    """A JSON object, or an empty one and the finding of what is wrong with it."""
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except (OSError, ValueError) as e:
        return {}, [finding("pipeline_stats_invalid", "the statistics can't be read", pipeline_stats_path=path, error=str(e))]
    if not isinstance(value, dict):
        return {}, [finding("pipeline_stats_invalid", "the statistics are no JSON object", pipeline_stats_path=path, actual_type=type(value).__name__)]
    return value, []


def read_required(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def reported_count(stats: dict, path: str = "") -> tuple[int | None, list[dict]]:
    """statistics.lines_output of a report, or the finding of why there is none; a report of another version has neither."""
    if stats.get("schema_version") != STATS_VERSION:
        return None, []
    about = {"pipeline_stats_path": path, "schema_version": STATS_VERSION}
    inner = stats.get("statistics")
    if not isinstance(inner, dict):
        return None, [finding("pipeline_statistics_invalid", "the report has no statistics", **about, field="statistics")]
    about["field"] = "statistics.lines_output"
    if "lines_output" not in inner:
        return None, [finding("pipeline_output_count_missing", "the report doesn't say how many rules it wrote", **about)]
    n = inner["lines_output"]
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        return None, [finding("pipeline_output_count_invalid", "the reported number of rules is none", **about, value=n)]
    return n, []


def canary_schema(config: dict, **where) -> list[dict]:
    """What is wrong with the frame of a canary configuration; a malformed one fails closed."""
    version = config.get("schema_version")
    if isinstance(version, bool) or not isinstance(version, int) or version not in CANARY_VERSIONS:
        return [finding("canary_schema_version", "unknown version of the canary configuration", **where, field="schema_version", schema_version=version, expected_versions=list(CANARY_VERSIONS))]
    names = [k for k in ("must_block", "must_allow") if (version == 1 or k in config)] + ["scoped_canaries"] * (version == 2 and "scoped_canaries" in config)
    return [finding("canary_config_invalid", f"{k} must be a list", **where, field=k, schema_version=version, expected="list") for k in names if not isinstance(config.get(k), list)]


def scoped_records(records: list, **where) -> tuple[list[dict], list[dict]]:
    """The well-formed scoped canaries with their defaults, and a finding for the first thing wrong with each other one."""
    good, bad = [], []
    one_of = lambda field, allowed: lambda r: isinstance(r.get(field), str) and r[field] in allowed
    checks = (
        ("name", lambda r: r.get("name") is None or isinstance(r["name"], str), "string"),
        ("domain", lambda r: isinstance(r.get("domain"), str) and r["domain"].strip() != "", "non-empty string"),
        ("expect", one_of("expect", EXPECTATIONS), list(EXPECTATIONS)),
        ("scope", one_of("scope", evidence.SCOPES), sorted(evidence.SCOPES)),
        ("gate", lambda r: "gate" not in r or one_of("gate", GATES)(r), list(GATES)),
    )
    for k, r in enumerate(records):
        at = f"scoped_canaries[{k}]"
        wrong = None
        if not isinstance(r, dict):
            wrong = (at, "object")
        elif extra := sorted(set(r) - set(CANARY_FIELDS)):
            wrong = (f"{at}.{extra[0]}", list(CANARY_FIELDS))
        else:
            wrong = next(((f"{at}.{field}", expected) for field, fine, expected in checks if not fine(r)), None)
        if wrong:
            bad.append(finding("canary_scoped_config_invalid", "a scoped canary isn't understood", **where, field=wrong[0], expected=wrong[1]))
        else:
            good.append({"name": r.get("name"), "domain": r["domain"].lower().strip().rstrip("."), "expect": r["expect"], "scope": r["scope"], "gate": r.get("gate", DEFAULT_GATE)})
    return good, bad


def check_canaries(spark: SparkSession, config: dict, rules: DataFrame, path: str | None = None) -> tuple[list[dict], dict]:
    """Findings about the canaries on rules (ord, line), and what each canary met."""
    where = {"canaries_path": path} if path else {}
    bad = canary_schema(config, **where)
    if bad:
        return bad, {}
    blocks, allows = ([str(d) for d in config.get(k, [])] for k in ("must_block", "must_allow"))
    errors: list[dict] = []
    met: dict[str, bool] = {}
    if blocks or allows:
        asked = spark.createDataFrame([(d,) for d in sorted(set(blocks + allows))], "domain string")
        met = {r.domain: r.blocked for r in simple_canaries(asked, blocked_domains(rules)).collect()}
    errors += [finding("canary_must_block_missing", "a domain that must be blocked isn't", domain=d) for d in blocks if not met[d]]
    errors += [finding("canary_must_allow_blocked", "a domain that must be allowed is blocked", domain=d) for d in allows if met[d]]
    good, bad = scoped_records(config.get("scoped_canaries", []), **where)
    if bad:
        return bad, {}
    results: list[dict] = []
    if good:
        asked = spark.createDataFrame([(k, *(c[f] for f in ("name", "domain", "expect", "scope", "gate"))) for k, c in enumerate(good)], "at int, name string, domain string, expect string, scope string, gate string")
        results = [r.asDict() for r in scoped_canaries(asked, rules).orderBy("at").collect()]
    for r in results:
        r.pop("at")
        if r["status"] == "failed" and r["gate"] == "hard":
            code = "canary_scoped_block_missing" if r["expect"] == "blocked" else "canary_scoped_allow_blocked"
            errors.append(finding(code, "a hard scoped canary isn't met", domain=r["domain"], scope=r["scope"], gate=r["gate"], name=r["name"]))
    details = {"schema_version": config["schema_version"], "must_block": [{"domain": d, "blocked": met[d]} for d in blocks], "must_allow": [{"domain": d, "blocked": met[d]} for d in allows]}
    return errors, details | ({"scoped": results} if config["schema_version"] == 2 else {})


def health_counts(report: dict) -> tuple[int, dict[str, int]]:
    """The number of sources and of each status; counted from the sources where the totals name none."""
    n, totals = int(report.get("source_count") or 0), report.get("totals_by_status")
    counts = {s: int(totals.get(s, 0)) if isinstance(totals, dict) else 0 for s in STATUSES}
    sources = report.get("sources")
    if n <= 0 and isinstance(sources, list):
        states = [str(x.get("status", "")) for x in sources if isinstance(x, dict)]
        n, counts = len(sources), {s: states.count(s) for s in STATUSES}
    return n, counts


def check_health(spark: SparkSession, report: dict, limits: Thresholds = LIMITS) -> tuple[list[dict], list[dict], dict]:
    """Errors, warnings and figures about the sources of a health report."""
    n, counts = health_counts(report)
    hard = lambda least: max(least, -int(-n * limits.source_hard_ratio // 1))
    row = {"source_count": n, "failed_stale": counts["failed"] + counts["stale_cache"], "fallback_stale": counts["fallback_cache"] + counts["stale_cache"], "degraded": sum(counts[s] for s in DEGRADED), "failed_stale_limit": hard(limits.source_failed_stale_minimum), "fallback_stale_limit": hard(limits.source_fallback_stale_minimum)}
    about = {
        "source_health_catastrophic_failed_stale": ("too many sources failed or are stale", {"failed_stale": row["failed_stale"], "limit": row["failed_stale_limit"]}),
        "source_health_catastrophic_fallback_stale": ("too many sources come from the cache or are stale", {"fallback_stale": row["fallback_stale"], "limit": row["fallback_stale_limit"]}),
        "source_health_degraded": ("some sources failed or came from the cache", {"degraded_sources": row["degraded"]}),
    }
    found = source_findings(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))).orderBy("position").collect()
    split = {sev: [finding(r.code, about[r.code][0], **about[r.code][1]) for r in found if r.severity == sev] for sev in ("error", "warning")}
    return split["error"], split["warning"], {"source_count": n, "totals_by_status": counts, "failed_stale": row["failed_stale"], "fallback_stale": row["fallback_stale"], "failed_stale_hard_limit": row["failed_stale_limit"], "fallback_stale_hard_limit": row["fallback_stale_limit"]}


def check_previous(spark: SparkSession, current: int, previous: int | None, limits: Thresholds = LIMITS) -> tuple[list[dict], list[dict], dict]:
    """Errors, warnings and figures about the change since the previous release."""
    known = previous is not None and previous > 0
    delta = current - previous if previous is not None else None
    ratio = round(abs(delta) / previous, 6) if known else None
    about = {
        "previous_output_unavailable": ("there is no previous release to compare with", {}),
        "previous_output_empty": ("the previous release is empty", {}),
        "previous_output_extreme_drop": ("the release lost too many rules", {"drop_ratio": ratio}),
        "previous_output_extreme_increase": ("the release gained too many rules", {"increase_ratio": ratio}),
        "previous_output_extreme_absolute_delta": ("the number of rules moved too far", {"absolute_delta": delta}),
        "previous_output_moderate_delta": ("the number of rules moved", {"relative_delta": ratio, "absolute_delta": delta}),
    }
    found = previous_findings(spark.createDataFrame([(current, previous)], "current_count long, previous_count long"), limits).orderBy("position").collect()
    split = {sev: [finding(r.code, about[r.code][0], **about[r.code][1]) for r in found if r.severity == sev] for sev in ("error", "warning")}
    return split["error"], split["warning"], {"available": known, "current_count": current, "previous_count": previous, "absolute_delta": delta, "relative_delta": ratio}


def health_context(report: dict) -> dict:
    """The sums of a health report that evidence carries; what can't be read counts as 0."""
    whole = lambda v: max(0, int(v)) if isinstance(v, int) or isinstance(v, str) and v.strip().lstrip("+-").isdigit() else 0
    if not report:
        return {"available": False, "source_count": 0, "totals_by_status": {}, "degraded_sources": 0}
    sources, totals = report.get("sources"), report.get("totals_by_status")
    n = whole(report.get("source_count")) or (len(sources) if isinstance(sources, list) else 0)
    if isinstance(totals, dict):
        counts = {str(k): whole(v) for k, v in totals.items() if str(k)}
    else:
        states = [str(s.get("status") or "") for s in sources if isinstance(s, dict)] if isinstance(sources, list) else []
        counts = {s: states.count(s) for s in set(states) if s}
    return {"available": True, "source_count": n, "totals_by_status": dict(sorted(counts.items())), "degraded_sources": sum(counts.get(s, 0) for s in DEGRADED)}


def sidecar(churn: dict | None, context: dict, records: list[dict], cap: int = evidence.SAMPLE_CAP) -> dict:
    """Evidence that decides nothing: churn, sources, and coverage records by their JSON, cap of them."""
    if cap < 1:
        raise ValueError("the cap must be at least 1")
    count = lambda key: dict(sorted({v: sum(r.get(key) == v for r in records) for v in {r[key] for r in records if r.get(key) is not None}}.items()))
    ordered = sorted(records, key=canonical)
    return {
        "schema_version": 1,
        "report_type": "release_evidence",
        "sample_cap": cap,
        "membership_churn": churn,
        "source_health_context": context or {"available": False},
        "coverage_summary": {"total_records": len(records), "sampled_records": min(len(records), cap), "by_effect": count("effect"), "by_scope": count("scope")},
        "coverage_records": ordered[:cap],
    }


def _output_errors(scan: DataFrame) -> list[dict]:
    """One finding for each that output_findings() has; a release that is fit has none, so their number is what is wrong with it."""
    out = []
    for r in output_findings(scan).join(scan.select("line_no", "names"), "line_no").orderBy("line_no").collect():
        more = {"modifiers": sorted(set(r.names))} if r.code == "output_unsupported_modifier" else {}
        out.append(finding(r.code, MESSAGES[r.code], line_number=r.line_no, rule=r.line, **more))
    return out


def validate_release(spark: SparkSession, *, source_health: str, pipeline_stats: str, output: str, canaries: str, previous_output: str | None = None, summary_json: str | None = None, summary_md: str | None = None, evidence_json: str | None = None, limits: Thresholds = LIMITS) -> dict:
    """All gates on the artifact at output; all arguments are paths. Returns the summary, which is written where paths are given."""
    health, config = read_required(source_health), read_required(canaries)
    stats, errors = read_stats(pipeline_stats)
    versions = [finding("source_health_schema_version", "unknown version of the source health")] if health.get("schema_version") != HEALTH_VERSION else []
    if not errors and stats.get("schema_version") != STATS_VERSION:
        versions.append(finding("pipeline_stats_schema_version", "unknown version of the statistics"))
    reported, bad = reported_count(stats, pipeline_stats)
    errors = versions + errors + bad
    bad, warnings, health_details = check_health(spark, health, limits)
    scan = scanned(read_artifact(spark, output))
    counts = scan_counts(scan).first().asDict()
    n = counts["lines_scanned"]
    errors += bad + _output_errors(scan)
    about = {
        "pipeline_output_count_mismatch": ("the artifact has another number of rules than was reported", {"pipeline_reported_output_rules": reported, "scanned_output_rules": n, "absolute_delta": abs((reported or 0) - n), "pipeline_stats_path": pipeline_stats, "schema_version": stats.get("schema_version"), "field": "statistics.lines_output"}),
        "output_below_minimum_count": ("the artifact has too few rules", {"current_count": n, "minimum": limits.minimum_output_rules}),
    }
    errors += [finding(r.code, about[r.code][0], **about[r.code][1]) for r in count_findings(spark.createDataFrame([(n, reported)], "scanned long, reported long"), limits).orderBy("position").collect()]
    rules = scan.select(F.col("line_no").alias("ord"), "line")
    bad, canary_details = check_canaries(spark, config, rules, canaries)
    errors += bad
    before = read_artifact(spark, previous_output).select(strip("line").alias("line")).where("line <> ''") if previous_output and os.path.exists(previous_output) else None
    bad, more, previous_details = check_previous(spark, n, before.count() if before is not None else None, limits)
    errors, warnings = errors + bad, warnings + more

    churn = evidence.churn(rules, before) if before is not None else None
    context = health_context(health)
    names = ("current", "previous", "added", "removed")
    # Without a previous release, what the artifact has is counted as it stands, with repeats.
    prints = {k: churn[f"{k}_fingerprint"] if churn else evidence.membership_fingerprint(rules).first().fingerprint if k == "current" else None for k in names}
    proof = {
        "schema_version": 1,
        "membership_churn": {"available": True, **churn} if churn else {"available": False, "current_count": n, **{f"{k}_count": None for k in names[1:]}},
        "output_fingerprints": prints,
        "source_health_context": context,
        "scoped_canaries": canary_details.get("scoped", []),
        "sidecar": {"available": bool(evidence_json), "path": evidence_json},
    }
    summary = {
        "schema_version": 1,
        "version": __version__,
        "generated_at": now(),
        "status": "failed" if errors else "passed",
        "errors": errors,
        "warnings": warnings,
        "thresholds": asdict(limits),
        "counts": {"current_output_rules": n} | ({"pipeline_reported_output_rules": reported} if reported is not None else {}),
        "source_health": health_details,
        "syntax": counts,
        "canaries": canary_details,
        "previous_release": previous_details,
        "release_evidence": proof,
    }
    if evidence_json and summary_json and summary_md:
        scoped = config.get("schema_version") == 2 and isinstance(config.get("scoped_canaries"), list) and bool(config["scoped_canaries"])
        save_json(evidence_json, sidecar(churn, context, evidence.coverage_sample(evidence.coverage(rules), whole=scoped)))
    if summary_json and summary_md:
        save_json(summary_json, summary)
        save_text(summary_md, markdown(summary))
    return summary


def markdown(summary: dict) -> str:
    """The summary for people."""

    def listed(title, rows):
        out = ["", f"### {title}"]
        for f in rows:
            out.append(f"- `{f['code']}`: {f['message']}")
            out += [f"  - `{k}`: {v}" for k, v in (f.get("details") or {}).items()] if f["code"] in DETAILED else []
        return out if rows else [*out, "- None"]

    head = [f"## Release Validation: {summary['status'].capitalize()}", "", f"- Current output rules: {summary['counts'].get('current_output_rules', 0):,}", f"- Errors: {len(summary['errors'])}", f"- Warnings: {len(summary['warnings'])}"]
    out = head + listed("Errors", summary["errors"]) + listed("Warnings", summary["warnings"]) + ["", "### Thresholds", *(f"- `{k}`: {v}" for k, v in summary["thresholds"].items())]
    proof = summary.get("release_evidence")
    if proof:
        churn, prints, context = proof["membership_churn"], proof["output_fingerprints"], proof["source_health_context"]
        out += ["", "### Release Evidence", f"- Membership churn: {churn['added_count']} added, {churn['removed_count']} removed" if churn["available"] else "- Membership churn: unavailable"]
        out += [f"- {k.capitalize()} fingerprint: {(prints[k] or 'unavailable')[:12]}" for k in ("current", "previous")]
        out += [f"- Source health context: {context['source_count']} sources, {context['degraded_sources']} degraded", f"- Scoped canaries: {len(proof['scoped_canaries'])}"]
        out += [f"- Evidence sidecar: {proof['sidecar']['path']}"] if proof["sidecar"]["available"] else []
    return "\n".join(out) + "\n"
