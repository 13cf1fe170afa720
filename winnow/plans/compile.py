"""The compiler: ordered lines to one merged, deduplicated list, with its statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.cover import judged
from ..operators.route import NONBLOCKING, classify, first_wins, indexed, records, route, with_scope
from ..sources.staging import counted, staged

EFFECTS = ("block", "exception", "rewrite", "disable", "ignored", "unsupported", "uncertain")


@dataclass
class Compiled:
    """lines: (ord, line) as given; found: every different line, routed, with ord of the first and n of them; kept: the indexed rules with their verdicts; exceptions; others: distinct other lines.

    routed (every line) and rules (every block record with nth) are as long as the input, and made only if asked for.
    """

    lines: DataFrame
    found: DataFrame
    kept: DataFrame
    exceptions: DataFrame
    others: DataFrame

    @cached_property
    def routed(self) -> DataFrame:
        lines, found = self.lines.select("ord", strip("line").alias("_line")), self.found.drop("ord", "n")
        return staged(lines.join(found, F.col("_line").eqNullSafe(F.col("line"))).drop("_line"), "lines")

    @cached_property
    def rules(self) -> DataFrame:
        return staged(first_wins(with_scope(records(self.routed)).where("not is_exception")), "records")

    def output(self) -> DataFrame:
        """(section, key_o, o, line) of the rules that stay, to be ordered by the first three and line."""
        stays = self.kept.where("verdict is null or verdict = 'kept_because_uncertain'")
        rules = stays.select(F.when(F.col("section") == "tld_wildcard", 0).otherwise(1).alias("section"), "key_o", "o", F.col("rule").alias("line"))
        nothing = F.lit(None).cast(self.kept.schema["o"].dataType)
        return rules.unionByName(self.others.select(F.lit(2).alias("section"), nothing.alias("key_o"), nothing.alias("o"), "line"))

    def ordered(self) -> DataFrame:
        return self.output().orderBy("section", "key_o", "o", "line")

    def stats(self) -> DataFrame:
        """One row of counters."""
        n = lambda cond, name: F.count_if(cond).alias(name)
        c, verdict = F.col, F.col("verdict")
        total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
        of = lambda cond, name: total(F.when(cond, c("n")), name)
        blank = c("route") == "blank"
        made = F.when(c("route") == "abp", 1).when(c("route").isin("hosts", "plain"), F.size("domains")).otherwise(0)
        lines = self.found.agg(
            total(c("n"), "total_input"),
            *[of((c("effect") == e) | (F.lit(e == "uncertain") & ~blank & c("uncertain")), f"rule_effect_{e}") for e in EFFECTS],
            of(c("route") == "malformed", "malformed_discarded"),
            of((c("route") == "nonblocking") & (c("reason") == "local_hostname_ignored"), "local_hostname_pruned"),
            of(c("route") == "other", "_other_lines"),
            total(c("n") * made, "_records"),
        )
        kept = self.kept.agg(
            F.count("*").alias("_first"),
            n(c("promoted"), "formats_compressed"),
            n(verdict == "exception_covered", "whitelist_conflict_pruned"),
            n(verdict == "tld_wildcard_covered", "tld_wildcard_pruned"),
            n(verdict.isin("parent_covered", "wildcard_covered"), "abp_subdomain_pruned"),
            n(verdict.isNull() | (verdict == "kept_because_uncertain"), "abp_kept"),
        )
        others = self.others.agg(F.count("*").alias("other_kept"), n(c("kind") == "regex", "regex_preserved_no_pruning"))
        one = lines.crossJoin(kept).crossJoin(others)
        return one.select(
            *[x for x in lines.columns if not x.startswith("_")],
            (c("_records") - c("_first") + c("_other_lines") - c("other_kept")).alias("duplicate_pruned"),
            "formats_compressed",
            c("formats_compressed").alias("compression_policy_broadened"),
            *[x for x in kept.columns if not x.startswith("_") and x != "formats_compressed"],
            *others.columns,
            (c("abp_kept") + c("other_kept")).alias("total_output"),
        )

    def cardinalities(self) -> DataFrame:
        """One row: distinct keys of the indexes."""
        kept = self.kept.agg(
            F.count_distinct(F.when(F.col("section") == "abp", F.col("storage_key"))).alias("abp_rule_keys"),
            F.count_distinct(F.when(F.col("section") == "tld_wildcard", F.col("tld"))).alias("abp_wildcard_keys"),
            F.count("*").alias("duplicate_index_size"),
        )
        exc = self.exceptions.agg(F.count_distinct(F.when(F.col("is_wildcard"), F.concat(F.lit("*."), "domain")).otherwise(F.col("domain"))).alias("exception_rule_keys"))
        return kept.crossJoin(exc).crossJoin(self.others.agg(F.count("*").alias("other_rule_count")))


def compile_rules(lines: DataFrame, different: DataFrame | None = None) -> Compiled:
    """Compile lines (ord, line), ord giving their order.

    Equal lines mean the same, so each different one is parsed, routed and indexed once, at the place of its first: the
    merged list has no other. different has them as counted() does, if they are known already.
    """
    if different is None:
        different = counted(lines.select("ord", strip("line").alias("line")), "line")
    found = staged(route(classify(different.select("line", "ord", "n"))), "routed")
    scoped = with_scope(records(found))
    index = staged(indexed(first_wins(scoped.where("not is_exception")).where("nth = 1")), "rules")
    exceptions = scoped.where("is_exception")
    kept = staged(judged(index, exceptions), "kept")
    return Compiled(lines.select("ord", "line"), found, kept, exceptions, found.where("route = 'other'").select("line", "ord", "kind"))


def stage_summaries(stats: dict, cardinalities: dict) -> dict:
    """Processed, emitted and discarded of each compile stage, from the counters."""
    v = lambda k: int(stats.get(k) or 0)
    entries = sum(int(x or 0) for x in cardinalities.values())
    pruned = {"abp_subdomain": v("abp_subdomain_pruned"), "tld_wildcard": v("tld_wildcard_pruned"), "whitelist_conflict": v("whitelist_conflict_pruned"), "local_hostname": v("local_hostname_pruned")}
    row = lambda p, e, d=0, reasons=None: {"processed": p, "emitted": e, "discarded": d, "reasons": {k: n for k, n in (reasons or {}).items() if n}}
    n, bad, dup, out = v("total_input"), v("malformed_discarded"), v("duplicate_pruned"), v("total_output")
    return {
        "parse": row(n, max(n - bad, 0), bad, {"malformed": bad}),
        "normalize": row(n, n),
        "classify": row(n, n, 0, {e: v(f"rule_effect_{e}") for e in EFFECTS}),
        "compress": row(v("formats_compressed"), v("formats_compressed"), 0, {"hosts_plain_promoted_to_abp": v("compression_policy_broadened")}),
        "index": row(entries + dup, entries, dup, {"duplicate": dup}),
        "prune": row(out + sum(pruned.values()), out, sum(pruned.values()), pruned),
        "write": row(out, out),
    }


__all__ = ["Compiled", "compile_rules", "stage_summaries", "NONBLOCKING"]
