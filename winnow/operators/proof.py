"""The record of decisions: what became of each rule, by which other rule, and whether that is proven."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.modifiers import signature_parts
from ..functions.suffix import domain_shape, with_suffix
from ..plans.compile import Compiled

DELTAS = ("changed", "gained", "lost", "not_applicable", "preserved", "uncertain")
DIMENSIONS = ("decision_type", "outcome", "proof_status", "reason", "strict_agh_delta", "project_policy_delta")
SAMPLE_CAP = 25
BUCKET = ("strict_agh_delta", "project_policy_delta", "reason", "outcome")


def _facet(raw, normalized, source_kind, rule_kind, domain, shape, effect, scope, urgent, basis, sig):
    return F.struct(
        raw.alias("raw_rule"), normalized.alias("normalized_rule"), source_kind.alias("source_kind"), rule_kind.alias("rule_kind"), domain.alias("domain"), shape.alias("domain_shape"),
        effect.alias("effect"), scope.alias("scope"), F.when(urgent, "important").otherwise("normal").alias("priority"), basis.alias("agh_behavior_basis"), sig.alias("modifier_signature"),
    )


def _record_facets(df: DataFrame) -> DataFrame:
    """df of rule records with suffix columns, with facet."""
    c = F.col
    return df.withColumn("facet", _facet(c("source_rule"), c("rule"), c("source_kind"), F.lit("abp"), c("domain"), domain_shape(c("domain"), c("is_wildcard")), c("source_effect"), c("source_scope"), c("x_urgent"), c("source_docs"), signature_parts(c("mods"))))


def _decision(df: DataFrame, phase, seq, kind, outcome, status, reason, strict, policy, detail, covering=None) -> DataFrame:
    c = lambda x: x if not isinstance(x, str) else F.lit(x)
    candidate = df.schema["facet"].dataType
    return df.select(
        (phase if not isinstance(phase, int) else F.lit(phase)).alias("phase"), seq.alias("seq"), c(kind).alias("decision_type"), c(outcome).alias("outcome"), c(status).alias("proof_status"), c(reason).alias("reason"), c(strict).alias("strict_agh_delta"), c(policy).alias("project_policy_delta"),
        F.col("facet").alias("candidate"), (covering if covering is not None else F.lit(None).cast(candidate)).alias("covering"), detail.alias("detail"),
    )


def decisions(done: Compiled) -> DataFrame:
    """One row for each decision, phase and seq giving their order.

    Phase 1 is what is decided on reading, in input order; phase 3 what the index decides, in its order; phase 4 suffix
    wildcards that an exception takes out, which is seen only when the list is written.
    """
    c, none = F.col, F.lit(None).cast("string")
    nobody = F.lit(None).cast(done.kept.schema["o"].dataType)
    at = lambda o, sub: F.struct(nobody.alias("key_o"), o.alias("o"), F.lit(sub).alias("sub"))
    first = F.struct(c("ord"), F.lit(0).alias("tok"))
    # Only lines that a decision is about are resolved further.
    quiet = "route = 'nonblocking' or (route = 'malformed' and effect in ('unsupported', 'disable', 'rewrite', 'ignored'))"
    lines = done.routed.where(f"({quiet}) or (kind = 'regex' and route = 'other')")
    domain = F.when(c("kind") == "abp", c("abp_domain")).when(c("kind") == "hosts", F.coalesce(F.get("domains", F.lit(0)), F.lit(""))).when(c("kind") == "plain_domain", F.lower("pattern")).otherwise("")
    lines = lines.withColumn("domain", domain)
    shaped = with_suffix(lines)
    shape = F.when(c("kind") == "regex", "regex").otherwise(domain_shape(c("domain"), c("abp_wildcard")))
    urgent = F.size(F.filter("mods", lambda m: (m["name"] == "important") & ~m["negated"] & m["raw_value"].isNull())) == 1
    shaped = shaped.withColumn("facet", _facet(c("line"), c("line"), c("kind"), c("kind"), c("domain"), shape, c("effect"), c("scope"), urgent, c("docs_source"), signature_parts(c("mods"))))
    changed = c("effect") == "rewrite"
    why = F.when(c("effect") == "unsupported", "unsupported_modifier_removed").when(c("effect") == "disable", "badfilter_disabled").when(changed, "dnsrewrite_changed").otherwise("ignored_nonblocking")
    delta = F.when(changed, "changed").otherwise("not_applicable")
    parts = [_decision(shaped.where(quiet), 1, at(first, 0), "nonblocking", F.when(changed, "changed").otherwise("removed"), "not_applicable", why, delta, delta, c("reason"))]
    regex = shaped.where("kind = 'regex' and route = 'other'").join(done.others.select("line", F.col("ord").alias("first_ord")), "line").where("ord = first_ord")
    parts.append(_decision(regex, 1, at(first, 0), "regex_uncertain", "kept", "uncertain", "regex_uncertain_kept", "uncertain", "uncertain", c("reason")))

    repeated = done.rules.where("nth > 1").select("kept_o", F.lit(True).alias("has_twin")).distinct()
    rules = _record_facets(with_suffix(done.rules.join(repeated, "kept_o", "left").where("promoted or has_twin").drop("has_twin")))
    o = F.struct("ord", "tok")
    twins = rules.where("nth > 1").join(rules.where("nth = 1").select(c("kept_o").alias("k_o"), c("facet").alias("kept_facet")), c("kept_o") == c("k_o"))
    parts.append(_decision(twins, 1, at(o, 0), "duplicate", "pruned", "proven", "duplicate_rule", "preserved", "preserved", none, c("kept_facet")))
    grown = rules.where("promoted and nth = 1")
    parts.append(_decision(grown, 1, at(o, 1), "cross_format_broadened", "changed", "proven", "cross_format_broadened", "gained", "preserved", c("source_scope")))

    kept = _record_facets(done.kept).where("verdict is not null")
    everyone = _record_facets(done.kept).select("o", F.lit(False).alias("is_exc"), c("facet").alias("by_facet"))
    exceptions = _record_facets(with_suffix(done.exceptions)).select(o.alias("o"), F.lit(True).alias("is_exc"), c("facet").alias("by_facet"))
    # A covering rule may be a duplicate's kept twin; exceptions have positions of their own.
    by = everyone.unionByName(exceptions).withColumnRenamed("o", "b_o")
    kept = kept.join(by, (c("by_o") == c("b_o")) & (c("by_exception") == c("is_exc")))
    removed, unsure = c("verdict") == "exception_covered", c("verdict") == "kept_because_uncertain"
    delta = F.when(removed, "changed").when(unsure, "uncertain").otherwise("preserved")
    seq = F.struct(c("key_o"), c("o"), F.lit(0).alias("sub"))
    parts.append(_decision(kept, F.when(c("section") == "tld_wildcard", 4).otherwise(3), seq, c("verdict"), F.when(removed, "removed").when(unsure, "kept").otherwise("pruned"), F.when(unsure, "uncertain").otherwise("proven"), c("verdict"), delta, delta, c("detail"), c("by_facet")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(decided: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by each dimension; deltas always list all their values."""
    counted = decided.groupingSets([[F.col(d)] for d in DIMENSIONS], *DIMENSIONS).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.coalesce(*[F.when(F.col("g") == ((1 << len(DIMENSIONS)) - 1) ^ (1 << (len(DIMENSIONS) - 1 - i)), F.lit(d)) for i, d in enumerate(DIMENSIONS)])
    found = counted.select(name.alias("dimension"), F.coalesce(*DIMENSIONS).alias("value"), "n")
    listed = decided.sparkSession.createDataFrame([(d, v) for d in DIMENSIONS[4:] for v in DELTAS], "dimension string, value string")
    return found.join(listed, ["dimension", "value"], "full").select("dimension", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def numbered(decided: DataFrame) -> DataFrame:
    """decided with decision_id: type and running number in the order of (phase, seq).

    Rows are sorted by ranges, and each range is told how many rows lie before it, so no task sees all of them.
    """
    from ..sources.staging import staged

    spark = decided.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id is the number of the partition above 33 bits of the row's place in it.
    placed = staged(decided.repartitionByRange(parts, "phase", "seq").sortWithinPartitions("phase", "seq").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before or [0]]), F.shiftright("_at", 33).cast("int"))
    return placed.withColumn("decision_id", F.format_string("%s:%06d", "decision_type", offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)).drop("_at")


def _facet_value(facet) -> dict | None:
    if facet is None:
        return None
    out = dict(facet)
    out["modifier_signature"] = [[m["name"], m["negated"], m["given"], [[v["value"], v["negated"]] for v in m["values"]], m["uncertain"], m["raw"]] for m in facet["modifier_signature"]]
    return out


def _as_tuples(value):
    return tuple(_as_tuples(v) for v in value) if isinstance(value, list) else value


def _sample(kind: str, detail: str | None, candidate: dict, covering: dict | None) -> dict:
    """What a report shows of a decision, by its type."""
    if kind in ("nonblocking", "regex_uncertain"):
        return {"effect_reason": detail, "docs_source": candidate["agh_behavior_basis"]}
    if kind == "cross_format_broadened":
        return {"input_scope": detail, "output_scope": "apex_and_subdomains", "policy": "project_policy_promotes_to_abp"}
    if kind == "duplicate":
        return {"duplicate_key": repr((candidate["domain"], candidate["normalized_rule"].startswith("||*."), "block", _as_tuples(candidate["modifier_signature"])))}
    rules = {"candidate_rule": candidate["normalized_rule"], "covering_rule": covering["normalized_rule"]}
    return rules | ({"reason_detail": detail} if kind == "kept_because_uncertain" else {"modifier_scope_proven": True})


FIELDS = ("decision_id", "decision_type", "outcome", "project_policy_delta", "proof_status", "reason", "strict_agh_delta")


def canonical(value) -> str:
    """JSON with sorted keys, without spaces, and text as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8")).hexdigest()


def fingerprinted(numbered_rows: DataFrame) -> DataFrame:
    """(decision_id, bucket columns, record, fingerprint): record is the decision as canonical JSON, fingerprint its SHA-256.

    The record holds nested lists of mixed types, which to_json() can't write; it is made on batches of rows.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                candidate, covering = _facet_value(r["candidate"]), _facet_value(r["covering"])
                record = {"candidate": candidate, "covering": covering, "sample": _sample(r["decision_type"], r["detail"], candidate, covering), **{k: r[k] for k in FIELDS}}
                out.append((r["decision_id"], *[r[k] for k in BUCKET], canonical(record), fingerprint(record)))
            yield pd.DataFrame(out, columns=["decision_id", *BUCKET, "record", "fingerprint"])

    used = numbered_rows.select(*FIELDS, "detail", "candidate", "covering")
    return used.mapInPandas(run, "decision_id string, " + "".join(f"{c} string, " for c in BUCKET) + "record string, fingerprint string")


def capped_samples(decided: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """decided rows that are among the first cap of their bucket, with at (1 .. cap) and bucket_total."""
    if cap < 1:
        raise ValueError("the cap must be at least 1")
    same = Window.partitionBy(*BUCKET)
    ranked = decided.withColumn("at", F.row_number().over(same.orderBy("phase", "seq"))).where(F.col("at") <= cap)
    return ranked.join(decided.groupBy(*BUCKET).agg(F.count("*").alias("bucket_total")), list(BUCKET))


def _counted(decided: DataFrame) -> dict:
    out: dict = {f"by_{d}": {} for d in DIMENSIONS}
    for r in summary(decided).collect():
        out[f"by_{r.dimension}"][r.value] = r.n
    return {"total_records": sum(out["by_reason"].values()), **{k: dict(sorted(v.items())) for k, v in out.items()}}


def full_report(decided: DataFrame) -> dict:
    """Every decision, by id and fingerprint. All records come to the driver: for small inputs."""
    rows = fingerprinted(numbered(decided)).select("record", "fingerprint").collect()
    records = [json.loads(r.record) | {"fingerprint": r.fingerprint} for r in rows]
    return {"schema_version": 1, "report_type": "full", "summary": _counted(decided), "records": sorted(records, key=lambda r: (r["decision_id"], r["fingerprint"]))}


def capped_report(decided: DataFrame, cap: int = SAMPLE_CAP) -> dict:
    """Exact counts, and of each bucket the first cap decisions; nothing else comes to the driver."""
    sampled = capped_samples(numbered(decided), cap)
    totals = {tuple(r[k] for k in BUCKET): r["bucket_total"] for r in sampled.select(*BUCKET, "bucket_total").distinct().collect()}
    found: dict = {}
    for r in fingerprinted(sampled).collect():
        record = json.loads(r.record)
        shown = {k: record[k] for k in ("decision_id", "decision_type", "sample")} | {"fingerprint": r.fingerprint, "candidate_rule": record["candidate"]["normalized_rule"], "candidate_domain": record["candidate"]["domain"], "covering_rule": record["covering"] and record["covering"]["normalized_rule"]}
        found.setdefault(tuple(r[k] for k in BUCKET), []).append(shown)
    buckets = [{"bucket": dict(zip(BUCKET, key)), "total_records": totals[key], "sampled_records": len(rows), "records": sorted(rows, key=lambda x: (x["decision_id"], x["fingerprint"]))} for key, rows in sorted(found.items())]
    return {"schema_version": 1, "report_type": "capped", "sample_cap": cap, "summary": _counted(decided), "sample_buckets": buckets}
