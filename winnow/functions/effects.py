"""What a rule does to DNS answers, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .modifiers import KNOWN, SCOPED
from .text import S, normalize_domain, tokens

BLOCKING_IPS = tuple(":: ::0 ::1 0.0.0.0 0:0:0:0:0:0:0:0 0:0:0:0:0:0:0:1 127.0.0.1".split())
LOCAL_NAMES = ("broadcasthost", "local", "localhost", "localhost.localdomain", *(f"ip6-{x}" for x in "allhosts allnodes allrouters localhost localnet loopback mcastprefix".split()))
DNS, HOSTS, POLICY = "adguard_dns_filtering_syntax", "adguard_home_hosts_blocklists", "project_policy"


def is_blocking_ip(ip: Column) -> Column:
    return ip.isin(*BLOCKING_IPS) | ip.startswith("0.") | ip.startswith("127.")


def before_comment(parts: Column) -> Column:
    """The elements before the first that begins with #."""
    at = F.array_position(F.transform(parts, lambda p: p.startswith("#")), True)
    return F.when(at > 0, F.slice(parts, F.lit(1), at.cast("int") - 1)).otherwise(parts)


def hosts_names(pattern: Column) -> Column:
    """The names of a hosts line that its effect rests on: none unless the address blocks; local ones left out."""
    parts = tokens(pattern)
    rest = before_comment(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))
    names = F.filter(F.transform(rest, normalize_domain), lambda d: (d != "") & ~d.isin(*LOCAL_NAMES))
    return F.when((F.size(parts) >= 2) & is_blocking_ip(F.get(parts, F.lit(0))), names).otherwise(F.array().cast("array<string>"))


def hosts_domains(line: Column) -> Column:
    """The domains that a hosts line stands for as rules: names of letters, digits, _ - and dots before a comment, local ones left out."""
    ip = F.regexp_extract(line, rf"^([\p{{Nd}}.:a-fA-F]+){S}+[^\n]+$", 1)
    rest = F.regexp_extract(line, rf"^[\p{{Nd}}.:a-fA-F]+{S}+([^\n]+)$", 1)
    names = F.filter(before_comment(tokens(rest)), lambda p: p.rlike(r"^[a-zA-Z0-9][\p{L}\p{N}_.-]*$"))
    domains = F.filter(F.transform(names, normalize_domain), lambda d: (d != "") & ~d.isin(*LOCAL_NAMES))
    return F.when((ip != "") & is_blocking_ip(ip), domains).otherwise(F.array().cast("array<string>"))


def _effect(effect: str, scope, reason, docs: str = DNS, uncertain=False) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(effect).alias("effect"), c(scope).alias("scope"), c(reason).alias("reason"), F.lit(docs).alias("docs_source"), c(uncertain).alias("uncertain"))


def with_effect(df: DataFrame) -> DataFrame:
    """df (with syntax and modifiers) with effect, scope, reason, docs_source and uncertain; the first matching case counts."""
    names, kind = F.col("mod_names"), F.col("kind")
    has = lambda n: F.array_contains(names, n)
    scoped = F.array_sort(F.array_intersect(names, F.array(*map(F.lit, SCOPED))))
    is_scoped, urgent = F.size(scoped) > 0, has("important")
    open_ = is_scoped | urgent
    scope = F.when(is_scoped, "scoped_apex_and_subdomains").otherwise("apex_and_subdomains")
    why = F.when(is_scoped, F.concat(F.lit("known_scoped_modifier:"), F.array_join(scoped, ","), F.lit(";no_global_coverage_proof"))).when(urgent, "known_priority_modifier:important;no_structural_pruning_proof").otherwise("abp_basic_apex_and_subdomains")
    promoted = _effect("block", "exact_host", "agh_exact_host_baseline;project_policy_promotes_to_abp", f"{HOSTS};{POLICY}")
    made = (
        F.when(F.col("is_invalid"), _effect("ignored", "none", "invalid_syntax"))
        .when(F.col("has_url_path"), _effect("unsupported", "none", "url_path_not_dns_rule", uncertain=True))
        .when(F.exists("mods", lambda m: m["uncertain"] | ~m["name"].isin(*KNOWN)), _effect("unsupported", "unsupported_modifier", "unsupported_or_uncertain_modifier", uncertain=True))
        .when(has("badfilter"), _effect("disable", "apex_and_subdomains", "badfilter_disables_matching_basic_rules"))
        .when(F.col("is_exception") & (kind == "regex"), _effect("exception", "regex", "regex_exception_preserved_dns_rule_no_structural_pruning_proof", uncertain=True))
        .when(F.col("is_exception") & (kind != "abp"), _effect("exception", "uncertain", "exception_scope_unproven", uncertain=True))
        .when(F.col("is_exception"), _effect("exception", scope, F.when(open_, F.concat(F.lit("exception_scope_unproven;"), why)).otherwise(why), uncertain=open_))
        .when(has("dnsrewrite"), _effect("rewrite", scope, F.when(open_, F.concat(F.lit("dnsrewrite_custom_response;"), why)).otherwise("dnsrewrite_custom_response"), uncertain=open_))
        .when(kind == "abp", _effect("block", scope, why, uncertain=open_))
        .when(kind == "regex", _effect("block", "regex", "regex_preserved_dns_rule_no_structural_pruning_proof", uncertain=True))
        .when((kind == "hosts") & (F.size(hosts_names(F.col("pattern"))) == 0), _effect("ignored", "none", "hosts_rule_without_blocking_domain", HOSTS))
        .when((kind == "plain_domain") & normalize_domain("pattern").isin(*LOCAL_NAMES), _effect("ignored", "none", "local_hostname_ignored", HOSTS))
        .when(kind.isin("hosts", "plain_domain"), promoted)
        .otherwise(_effect("uncertain", "uncertain", "unclassified_dns_rule_syntax", uncertain=True))
    )
    return df.withColumn("_effect", made).select(*df.columns, "_effect.*")
