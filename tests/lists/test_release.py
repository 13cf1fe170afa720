import io
import json
import random
import urllib.error

import pytest

from winnow.operators import evidence, validate
from winnow.operators.proof import capped_report, capped_samples, decisions, fingerprint, fingerprinted, full_report, numbered, summary
from winnow.plans import bench, registry, release
from winnow.plans.compile import compile_rules
from winnow.plans.pipeline import process_files, summary_text
from winnow.sources import health, lists
from winnow.streaming.ingest import clean_stream


def lines_of(spark, lines, column="ord"):
    return spark.createDataFrame(list(enumerate(lines, 1)), f"{column} long, line string")


def test_decisions(spark):
    lines = ["||a.org^", "||a.org^", "0.0.0.0 b.org", "||c.a.org^", "||*.autos^", "||q.autos^", "@@||b.org^", "/r/", "||d.org^$badfilter", "||e.org^$dnsrewrite=1.1.1.1", "||f.org^$client=x", "||g.f.org^"]
    got = [(r.decision_type, r.outcome, r.proof_status, r.strict_agh_delta, r.candidate.raw_rule, r.covering and r.covering.raw_rule) for r in numbered(decisions(compile_rules(lines_of(spark, lines)))).orderBy("phase", "seq").collect()]
    assert got == [
        ("duplicate", "pruned", "proven", "preserved", "||a.org^", "||a.org^"),
        ("cross_format_broadened", "changed", "proven", "gained", "0.0.0.0 b.org", None),
        ("regex_uncertain", "kept", "uncertain", "uncertain", "/r/", None),
        ("nonblocking", "removed", "not_applicable", "not_applicable", "||d.org^$badfilter", None),
        ("nonblocking", "changed", "not_applicable", "changed", "||e.org^$dnsrewrite=1.1.1.1", None),
        ("exception_covered", "removed", "proven", "changed", "0.0.0.0 b.org", "@@||b.org^"),
        ("parent_covered", "pruned", "proven", "preserved", "||c.a.org^", "||a.org^"),
        ("tld_wildcard_covered", "pruned", "proven", "preserved", "||q.autos^", "||*.autos^"),
        ("kept_because_uncertain", "kept", "uncertain", "uncertain", "||g.f.org^", "||f.org^$client=x"),
    ]
    decided = decisions(compile_rules(lines_of(spark, lines)))
    counts = {(r.dimension, r.value): r.n for r in summary(decided).collect()}
    assert counts["outcome", "pruned"] == 3 and counts["strict_agh_delta", "lost"] == 0
    prints = [r.fingerprint for r in fingerprinted(numbered(decided)).collect()]
    assert len(set(prints)) == len(prints)
    assert max(r["at"] for r in capped_samples(decided, 1).collect()) == 1
    with pytest.raises(ValueError):
        capped_samples(decided, 0)


def test_a_suffix_wildcard_goes_last(spark):
    lines = ["||*.autos^", "@@||autos^", "||b.org^", "||x.b.org^", "@@||q.org^", "||q.org^"]
    got = [(r.phase, r.decision_id) for r in numbered(decisions(compile_rules(lines_of(spark, lines)))).orderBy("phase", "seq").collect()]
    assert got == [(3, "parent_covered:000001"), (3, "exception_covered:000002"), (4, "exception_covered:000003")]


def test_proof_reports(spark):
    lines = ["||dup.org^$client=1.1.1.1,dnstype=a", "||dup.org^$dnstype=A,client=1.1.1.1", "||u.org^", "@@||u.org^$client=1.1.1.1", "||new.org^$future=x", "0.0.0.0 host.org", "||p.org^", "||c.p.org^"]
    decided = decisions(compile_rules(lines_of(spark, lines)))
    full = full_report(decided)
    by = {r["decision_id"]: r for r in full["records"]}
    assert list(by) == ["cross_format_broadened:000003", "duplicate:000001", "kept_because_uncertain:000004", "nonblocking:000002", "parent_covered:000005"]
    twin = by["duplicate:000001"]
    sig = [["client", False, True, [["1.1.1.1", False]], False, ""], ["dnstype", False, True, [["A", False]], False, ""]]
    assert twin["candidate"]["modifier_signature"] == sig and twin["covering"]["raw_rule"] == lines[0]
    assert twin["sample"]["duplicate_key"] == "('dup.org', False, 'block', (('client', False, True, (('1.1.1.1', False),), False, ''), ('dnstype', False, True, (('A', False),), False, '')))"
    assert by["nonblocking:000002"]["candidate"]["modifier_signature"][0][4:] == [True, "future=x"]
    assert by["kept_because_uncertain:000004"]["sample"]["reason_detail"] == "exception_domain_scope_matched_modifier_scope_unproven"
    for r in full["records"]:
        assert r["fingerprint"] == fingerprint({k: v for k, v in r.items() if k != "fingerprint"})
    assert full["summary"]["total_records"] == 5 and full["summary"]["by_strict_agh_delta"]["lost"] == 0
    capped = capped_report(decided, 1)
    assert [b["bucket"]["reason"] for b in capped["sample_buckets"]] == ["cross_format_broadened", "unsupported_modifier_removed", "duplicate_rule", "parent_covered", "kept_because_uncertain"]
    assert all(b["records"][0]["fingerprint"] == by[b["records"][0]["decision_id"]]["fingerprint"] for b in capped["sample_buckets"])
    nothing = capped_report(decisions(compile_rules(lines_of(spark, ["# nothing"]))))
    assert nothing["sample_buckets"] == [] and nothing["summary"]["total_records"] == 0


def test_churn(spark):
    now, before = lines_of(spark, [" a ", "b", "b", ""]), lines_of(spark, ["b", "c", "d"])
    got = evidence.churn(now, before, 1)
    assert (got["current_count"], got["previous_count"], got["added_count"], got["removed_count"]) == (2, 3, 1, 2)
    assert got["added_samples"] == ["a"] and got["removed_samples"] == ["c"] and got["current_fingerprint"] == fingerprint(["a", "b"]) and got["removed_fingerprint"] == fingerprint(["c", "d"])
    with pytest.raises(ValueError):
        evidence.churn(now, before, 0)


HEALTH = {"schema_version": 1, "source_count": 40, "totals_by_status": {"failed": 5, "fallback_cache": 9, "fresh_fetch": 26}}


def released(spark, tmp_path, lines, canaries, stats=None, health=HEALTH, previous=None, minimum=10):
    for name, value in (("health", health), ("canaries", canaries), ("stats", {"schema_version": 4, "statistics": {"lines_output": len([x for x in lines if x])}} if stats is None else stats)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "out.txt").write_text("\n".join(lines) + "\n")
    if previous is not None:
        (tmp_path / "previous.txt").write_text("\n".join(previous))
    at = lambda name: str(tmp_path / name)
    return release.validate_release(spark, source_health=at("health.json"), pipeline_stats=at("stats.json"), output=at("out.txt"), canaries=at("canaries.json"), previous_output=at("previous.txt"), summary_json=at("s.json"), summary_md=at("s.md"), evidence_json=at("e.json"), limits=validate.Thresholds(minimum_output_rules=minimum))


def test_all_gates(spark, tmp_path):
    lines = ["||a.org^", "", "@@||b.org^", "||c.org/x", "||d.org^$script", "||^", "||*.w.org^", "||s.org^$client=x"]
    scoped = lambda **kw: kw
    canaries = {
        "schema_version": 2,
        "must_block": ["x.a.org", "q.w.org", "missing.org", "s.org"],
        "must_allow": ["w.org", "a.org"],
        "scoped_canaries": [scoped(domain="A.org.", expect="blocked", scope="apex", gate="hard"), scoped(domain="s.org", expect="blocked", scope="apex", gate="hard"), scoped(domain="q.w.org", expect="allowed", scope="wildcard_child", gate="hard"), scoped(domain="z.org", expect="blocked", scope="apex", name="n"), scoped(domain="a.org", expect="allowed", scope="apex")],
    }
    done = released(spark, tmp_path, lines, canaries, {"schema_version": 4, "statistics": {"lines_output": 9}}, previous=["x"] * 20)
    got = [(f["code"], f.get("details", {}).get("domain") or f.get("details", {}).get("line_number")) for f in done["errors"]]
    assert got == [
        ("source_health_catastrophic_failed_stale", None), ("source_health_catastrophic_fallback_stale", None),
        ("output_exception_rule", 3), ("output_url_path", 4), ("output_unsupported_modifier", 5), ("output_invalid_syntax", 6),
        ("pipeline_output_count_mismatch", None), ("output_below_minimum_count", None),
        ("canary_must_block_missing", "missing.org"), ("canary_must_allow_blocked", "a.org"), ("canary_scoped_block_missing", "s.org"), ("canary_scoped_allow_blocked", "q.w.org"),
        ("previous_output_extreme_drop", None),
    ]
    assert done["warnings"] == [] and done["status"] == "failed" and json.loads((tmp_path / "s.json").read_text()) == json.loads(json.dumps(done))
    # A scoped canary without a gate is told about, and doesn't fail the release.
    assert [(c["status"], c["gate"]) for c in done["canaries"]["scoped"]] == [("passed", "hard"), ("failed", "hard"), ("failed", "hard"), ("failed", "diagnostic"), ("failed", "diagnostic")]
    assert done["errors"][0]["details"] == {"failed_stale": 5, "limit": 4} and done["errors"][12]["details"] == {"drop_ratio": 0.65}
    text = (tmp_path / "s.md").read_text()
    assert "## Release Validation: Failed" in text and "  - `scanned_output_rules`: 7" in text and "- Scoped canaries: 5" in text and "7 added, 1 removed" in text
    side = json.loads((tmp_path / "e.json").read_text())
    assert side["coverage_records"] == sorted(side["coverage_records"], key=lambda r: json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    assert side["coverage_summary"]["by_effect"]["block"] >= 2 and side["membership_churn"]["added_count"] == 7 and "errors" not in side


def test_a_good_release_passes(spark, tmp_path):
    done = released(spark, tmp_path, ["||a.org^", "||b.org^"], {"schema_version": 1, "must_block": ["x.a.org"], "must_allow": []}, health={"schema_version": 1, "sources": [{"status": "fresh_fetch"}, {"status": "failed"}]}, minimum=2)
    assert done["errors"] == [] and [f["code"] for f in done["warnings"]] == ["source_health_degraded", "previous_output_unavailable"]
    assert done["previous_release"] == {"available": False, "current_count": 2, "previous_count": None, "absolute_delta": None, "relative_delta": None}
    assert done["release_evidence"]["output_fingerprints"]["current"] == fingerprint(["||a.org^", "||b.org^"]) and "scoped" not in done["canaries"]


def test_versions_and_counts_of_reports(spark, tmp_path):
    good = {"schema_version": 2}
    codes = lambda **kw: [f["code"] for f in released(spark, tmp_path, ["||a.org^"], good, minimum=1, **kw)["errors"]]
    assert codes(stats={"schema_version": 3}, health={"schema_version": 2}) == ["source_health_schema_version", "pipeline_stats_schema_version"]
    assert codes(stats=[1]) == ["pipeline_stats_invalid", "source_health_catastrophic_failed_stale", "source_health_catastrophic_fallback_stale"]
    assert release.reported_count({"schema_version": 4, "statistics": {"lines_output": 3}}) == (3, [])
    for inner, code in (([], "pipeline_statistics_invalid"), ({}, "pipeline_output_count_missing"), ({"lines_output": True}, "pipeline_output_count_invalid"), ({"lines_output": -1}, "pipeline_output_count_invalid")):
        assert release.reported_count({"schema_version": 4, "statistics": inner})[1][0]["code"] == code


@pytest.mark.parametrize(
    "config,want,field",
    [
        ({}, "canary_schema_version", "schema_version"),
        ({"schema_version": True}, "canary_schema_version", "schema_version"),
        ({"schema_version": 1, "must_block": "x", "must_allow": []}, "canary_config_invalid", "must_block"),
        ({"schema_version": 1, "must_block": []}, "canary_config_invalid", "must_allow"),
        ({"schema_version": 2, "scoped_canaries": {}}, "canary_config_invalid", "scoped_canaries"),
        ({"schema_version": 2, "scoped_canaries": [1]}, "canary_scoped_config_invalid", "scoped_canaries[0]"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "blocked"}]}, "canary_scoped_config_invalid", "scoped_canaries[0].scope"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "not_blocked", "scope": "apex"}]}, "canary_scoped_config_invalid", "scoped_canaries[0].expect"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "blocked", "scope": "all"}]}, "canary_scoped_config_invalid", "scoped_canaries[0].scope"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "blocked", "scope": "apex", "gate": "soft"}]}, "canary_scoped_config_invalid", "scoped_canaries[0].gate"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "blocked", "scope": "apex", "zzz": 1}]}, "canary_scoped_config_invalid", "scoped_canaries[0].zzz"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": " ", "expect": "blocked", "scope": "apex"}]}, "canary_scoped_config_invalid", "scoped_canaries[0].domain"),
        ({"schema_version": 2, "scoped_canaries": [{"domain": "a", "expect": "blocked", "scope": "apex", "name": 1}]}, "canary_scoped_config_invalid", "scoped_canaries[0].name"),
    ],
)
def test_malformed_canaries_fail(spark, config, want, field):
    errors, details = release.check_canaries(spark, config, lines_of(spark, ["||a.org^"]), "c.json")
    assert [(f["code"], f["details"]["field"], f["details"]["canaries_path"]) for f in errors] == [(want, field, "c.json")] and details == {}


@pytest.mark.parametrize("now,before,code", [(74, 100, "previous_output_extreme_drop"), (201, 100, "previous_output_extreme_increase"), (75, 100, "previous_output_moderate_delta"), (110, 100, None), (5_000_001, 4_000_000, "previous_output_extreme_absolute_delta"), (1, 0, "previous_output_empty"), (1, None, "previous_output_unavailable")])
def test_previous_delta(spark, now, before, code):
    errors, warnings, _ = release.check_previous(spark, now, before)
    assert [f["code"] for f in errors + warnings] == [code] * (code is not None)


def test_health_context():
    assert release.health_context({})["available"] is False
    got = release.health_context({"source_count": "3", "totals_by_status": {"stale_cache": "2", "odd": 1, "failed": "x"}})
    assert got == {"available": True, "source_count": 3, "totals_by_status": {"failed": 0, "odd": 1, "stale_cache": 2}, "degraded_sources": 2}
    with pytest.raises(ValueError):
        release.sidecar(None, {}, [], 0)


def test_health(spark):
    rows = [(True, True, None, None), (True, False, None, 5), (True, False, "x", 172_800), (True, False, "x", 172_801), (True, False, "x", None), (False, False, "x", None)]
    got = health.with_status(spark.createDataFrame(rows, "success boolean, changed boolean, error string, cache_age_seconds long"))
    assert [r.status for r in got.collect()] == ["fresh_fetch", "validated_cache", "fallback_cache", "stale_cache", "stale_cache", "failed"]


class Answer(io.BytesIO):
    headers = {"ETag": '"1"', "Last-Modified": "then"}


def test_fetch(tmp_path):
    out, cache = tmp_path / "out", tmp_path / "cache"
    asked, plan = [], []

    def opener(request, timeout):
        asked.append(dict(request.headers))
        step = plan.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    fail = lambda code: urllib.error.HTTPError("u", code, "m", {}, None)
    url = "https://lists.example.org/a.txt"
    get = lambda *steps: (plan.extend(steps), health.fetch_all([url], str(out), str(cache), opener=opener, sleep=lambda s: None)[0])[1]
    assert get(fail(500), fail(500), fail(500)) == {"url": url, "success": False, "changed": False, "error": "HTTP 500"}
    assert get(fail(503), Answer(b"x"))["changed"] and (out / health.url_to_filename(url)).read_bytes() == b"x"
    assert get(fail(304)) == {"url": url, "success": True, "changed": False, "error": None} and asked[-1]["If-none-match"] == '"1"'
    assert get(OSError("down"), OSError("down"), OSError("down")) == {"url": url, "success": True, "changed": False, "error": "down"}


def test_a_folder_becomes_one_file(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "b.txt").write_bytes("﻿||z.org^\r\n0.0.0.0 a.org\r\n".encode() + b"\xff||bad\n" * 1)
    (raw / "a.txt").write_text("||a.org^\n# c\n||b.a.org^")
    (raw / "c.lst").write_text("||no.org^\n")
    report = process_files(spark, str(raw), str(tmp_path / "out.txt"), str(tmp_path / "s.json"), str(tmp_path / "p.json"))
    assert (tmp_path / "out.txt").read_text() == "||a.org^\n||z.org^\n�||bad\n"
    stages = json.loads((tmp_path / "s.json").read_text())["stage_summaries"]["cleaner"]
    assert stages["prefilter"]["reasons"] == {"comment": 1} and stages["emit"]["emitted"] == 5 and stages["normalize"]["processed"] == 4
    s = json.loads((tmp_path / "s.json").read_text())["statistics"]
    assert s["lines_raw"] == 6 and s["comments_removed"] == 1 and s["duplicate_pruned"] == 1 and s["lines_output"] == 3 and s["trimmed"] == 4
    assert len(json.loads((tmp_path / "p.json").read_text())["sample_buckets"]) >= 2 and "3 rules" in summary_text(report)
    assert report["runtime_profile"]["byte_sizes"]["raw_input_bytes"] == sum(f.stat().st_size for f in raw.glob("*.txt")) and report["semantics"]["compression_policy"]["hosts_plain_promoted_to_abp"] == 0
    read = [(r.file_name, r.line_no, r.had_newline) for r in lists.read_lists(spark, str(raw)).orderBy("file_idx", "line_no").collect()]
    assert read[:3] == [("a.txt", 1, True), ("a.txt", 2, True), ("a.txt", 3, False)]
    files = lists.content_identity(spark, str(raw))
    state = files.selectExpr("filename", "'u' as url", "'fresh_fetch' as status")
    kept = bench.manifest(spark, str(raw), state)
    assert bench.manifest_errors(kept, spark, str(raw)).count() == 0
    (raw / "a.txt").write_text("||a.org^\n# d\n||b.a.org^")
    (raw / "d.txt").write_text("x")
    assert {(r.filename, r.problem) for r in bench.manifest_errors(spark.createDataFrame(kept.collect(), kept.schema), spark, str(raw)).collect()} >= {("d.txt", "unlisted")}
    with pytest.raises(ValueError):
        bench.manifest(spark, str(raw), state.where("filename = 'a.txt'").limit(0))
    q = clean_stream(spark, str(raw), str(tmp_path / "stream"), str(tmp_path / "ckpt"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "stream")).where("line is not null").count() >= 4


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    """Files cut into many blocks, with every kind of line end, marks, undecodable bytes and last lines with and without an end."""
    r = random.Random(1)
    files = {"a.txt": b"x\ny\r\nz", "b.txt": b"\xef\xbb\xbfone\ntwo\n", "c.txt": b"\xef\xbb\xbfone\ntwo", "d.txt": b"p\rq\r", "e.txt": b"\n\n", "f.txt": b"\xff\xfebad\nok\n", "g.txt": b"p\rq", "h.txt": b""}
    for k, end in enumerate((b"\n", b"\r\n", b"\r") * 2):
        files[f"r{k}.txt"] = end.join(b"line%d " % i + b"x" * r.randrange(40) for i in range(60)) + (end if k % 2 else b"")
    want = []
    for n, name in enumerate(sorted(x for x in files if files[x])):
        lines = io.StringIO(files[name].decode("utf-8-sig", "replace"), newline=None)
        want += [(n, name, no, x.rstrip("\n"), x.endswith("\n")) for no, x in enumerate(lines, 1)]
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "8")
        assert lists._text(spark, str(tmp_path)).select("file_name", "block").distinct().count() > 100
        assert [tuple(x) for x in lists.read_lists(spark, str(tmp_path)).orderBy("file_idx", "line_no").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("files", [{}, {"a.txt": "", "b.txt": ""}])
def test_no_lines_at_all(spark, tmp_path, files):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, text in files.items():
        (raw / name).write_text(text)
    report = process_files(spark, str(raw), str(tmp_path / "out.txt"))
    assert report["statistics"]["files_processed"] == len(files) and report["statistics"]["lines_output"] == 0 and (tmp_path / "out.txt").read_text() == ""
    with pytest.raises(FileNotFoundError):
        process_files(spark, str(tmp_path / "none"), str(tmp_path / "out.txt"))


def test_health_report_of_a_fetch(spark, tmp_path):
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    answers = {"https://h.org/a": Answer(b"||a.org^\n"), "https://h.org/b": OSError("down"), "https://h.org/c": Answer(b"old")}
    running, most = [], []

    def opener(request, timeout):
        running.append(1)
        most.append(len(running))
        running.pop()
        step = answers[request.full_url]
        if isinstance(step, Exception):
            raise step
        return step

    urls = list(answers)
    health.fetch_all(urls[2:], out, cache, opener=opener)
    answers[urls[2]] = OSError("gone")
    results = health.fetch_all(urls, out, cache, opener=opener, sleep=lambda s: None)
    report = health.health_report(spark, results, out, cache, when=4e9)
    assert [s["status"] for s in report["sources"]] == ["fresh_fetch", "failed", "stale_cache"] and max(most) <= health.PER_HOST
    assert report["sources"][0]["byte_size"] == 9 and report["sources"][1]["sha256"] is None and report["sources"][2]["failure_reason"] == "gone"
    assert report["totals_by_status"] == {"failed": 1, "fallback_cache": 0, "fresh_fetch": 1, "stale_cache": 1, "validated_cache": 0}
    (tmp_path / "h.json").write_text(json.dumps(report))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("||a.org^\n")
    stats = process_files(spark, str(tmp_path / "raw"), str(tmp_path / "merged.txt"), str(tmp_path / "s.json"), health_path=str(tmp_path / "h.json"))
    seen = stats["runtime_profile"]["source_health"]
    assert seen["available"] and seen["failed_sources"] == 1 and seen["total_byte_size"] == 12 and seen["report_path"] == "h.json"
    # Our validator takes our own reports.
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 2, "must_block": ["a.org"]}))
    done = release.validate_release(spark, source_health=str(tmp_path / "h.json"), pipeline_stats=str(tmp_path / "s.json"), output=str(tmp_path / "merged.txt"), canaries=str(tmp_path / "c.json"), limits=validate.Thresholds(minimum_output_rules=1))
    assert done["errors"] == [] and done["counts"]["pipeline_reported_output_rules"] == 1


@pytest.mark.parametrize("path,want", [(None, None), (" ", None), ("a/b.json", "a/b.json"), ("/else/reports/x/h.json", "reports/x/h.json"), ("/else/h.json", "h.json"), ("/base/in/h.json", "in/h.json")])
def test_compact_paths(path, want):
    assert health.compact_path(path, "/base") == want
    with pytest.raises(ValueError):
        health.compact_path("../h.json")


def test_catalog(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# all\nhttps://a.example.org/x.txt # good\n\n  https://b.org/y  \n")
    assert [r.url for r in lists.read_catalog(spark, str(tmp_path / "c.txt")).orderBy("line_no").collect()] == ["https://a.example.org/x.txt", "https://b.org/y"]


def test_percentiles():
    assert validate.percentile_row([4, 1, 3, 2]) == {"min_seconds": 1, "max_seconds": 4, "p50_seconds": 2.5, "p95_seconds": 4} and validate.percentile_row([])["p95_seconds"] == 0


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
