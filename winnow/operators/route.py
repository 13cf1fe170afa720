"""From classified lines to rule records: which index a line goes to, and what it becomes there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.effects import hosts_domains, with_effect
from ..functions.modifiers import scope_columns, with_modifiers
from ..functions.suffix import with_suffix
from ..functions.syntax import PLAIN_DOMAIN, with_syntax
from ..functions.text import S, normalize_domain, strip

ABP_DOMAIN = r"^(@@)?\|\|(\*\.)?([^\^$|*" + S[1:-1] + r"]+)\^"
NONBLOCKING = ("rewrite", "disable", "ignored", "unsupported")


def classify(lines: DataFrame) -> DataFrame:
    """lines (ord, line) with syntax, modifiers and effect; blank lines are kept with a null kind."""
    out = with_effect(with_modifiers(with_syntax(lines.withColumn("line", strip("line")))))
    blank = F.col("line") == ""
    return out.withColumn("kind", F.when(~blank, F.col("kind"))).withColumn("effect", F.when(~blank, F.col("effect")))


def with_abp(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """df with abp_domain ('' if it is no such rule) and abp_wildcard of a pattern."""
    return df.withColumn("abp_domain", normalize_domain(F.regexp_extract(pattern, ABP_DOMAIN, 3))).withColumn("abp_wildcard", F.regexp_extract(pattern, ABP_DOMAIN, 2) != "")


def route(classified: DataFrame) -> DataFrame:
    """classified with abp_domain, abp_wildcard, domains (of hosts and plain lines) and route: blank, malformed, nonblocking, exception, abp, hosts, plain, other or dropped."""
    out = with_abp(classified)
    line = F.col("line")
    looks_abp = line.startswith("||") | line.startswith("@@||")
    out = out.withColumn("domains", F.when(~looks_abp & ~line.startswith("@@"), hosts_domains(line)).otherwise(F.array().cast("array<string>")))
    where = (
        F.when(F.col("kind").isNull(), "blank")
        .when(F.col("has_url_path") | F.col("is_invalid"), "malformed")
        .when(F.col("effect").isin(*NONBLOCKING), "nonblocking")
        .when(looks_abp & (F.regexp_extract("pattern", ABP_DOMAIN, 3) == ""), "malformed")
        .when(line.startswith("@@||"), "exception")
        .when(looks_abp, "abp")
        .when(line.startswith("@@"), "dropped")
        .when(F.size("domains") > 0, "hosts")
        .when(line.rlike(PLAIN_DOMAIN), "plain")
        .when(line.startswith("/") | F.contains(line, F.lit("|")) | F.contains(line, F.lit("*")), "other")
        .otherwise("dropped")
    )
    out = out.withColumn("route", where)
    return out.withColumn("domains", F.when(F.col("route") == "plain", F.array(normalize_domain("line"))).when(F.col("route") == "hosts", F.col("domains")).otherwise(F.array().cast("array<string>")))


def records(routed: DataFrame) -> DataFrame:
    """(ord, tok, rule, domain, is_wildcard, is_exception, promoted, sig, mods, source columns) of the routed lines; a hosts line gives one record for each name."""
    source = (F.col("line").alias("source_rule"), F.col("kind").alias("source_kind"), F.col("effect").alias("source_effect"), F.col("scope").alias("source_scope"), F.col("reason").alias("source_reason"), F.col("docs_source").alias("source_docs"))
    direct = routed.where(F.col("route").isin("abp", "exception")).select("ord", F.lit(0).alias("tok"), F.col("line").alias("rule"), F.col("abp_domain").alias("domain"), F.col("abp_wildcard").alias("is_wildcard"), (F.col("route") == "exception").alias("is_exception"), F.lit(False).alias("promoted"), "sig", "mods", *source)
    named = routed.where(F.col("route").isin("hosts", "plain")).select("*", F.posexplode("domains").alias("tok", "d"))
    none = F.array().cast(routed.schema["mods"].dataType)
    promoted = named.select("ord", "tok", F.concat(F.lit("||"), "d", F.lit("^")).alias("rule"), F.col("d").alias("domain"), F.lit(False).alias("is_wildcard"), F.lit(False).alias("is_exception"), F.lit(True).alias("promoted"), F.lit("").alias("sig"), none.alias("mods"), *source)
    return direct.unionByName(promoted)


def with_scope(df: DataFrame) -> DataFrame:
    return df.withColumns(scope_columns(F.col("mods")))


def first_wins(rules: DataFrame) -> DataFrame:
    """rules with nth (1 for the first of its domain, wildcard and meaning in input order) and kept_o, the position of that first one."""
    same = Window.partitionBy("domain", "is_wildcard", "sig").orderBy("ord", "tok")
    return rules.withColumn("nth", F.row_number().over(same)).withColumn("kept_o", F.first(F.struct("ord", "tok")).over(same))


def indexed(deduplicated: DataFrame) -> DataFrame:
    """The kept rules with suffix columns, storage_key, section (abp or tld_wildcard), o (position) and key_o (where the key first occurs)."""
    out = with_suffix(deduplicated)
    out = out.withColumn("o", F.struct("ord", "tok")).withColumn("storage_key", F.when(F.col("is_wildcard"), F.concat(F.lit("*."), "domain")).otherwise(F.col("domain")))
    out = out.withColumn("section", F.when(F.col("is_wildcard") & (F.col("tld") == F.col("domain")), "tld_wildcard").otherwise("abp"))
    return out.withColumn("key_o", F.min("o").over(Window.partitionBy("domain", "storage_key")))
