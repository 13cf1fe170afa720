"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import REASONS, clean
from ..functions.suffix import with_suffix
from ..functions.text import strip
from ..operators.route import classify, first_wins, records, route
from ..sources.staging import counted, staged
from .compile import EFFECTS, Compiled, compile_rules
from .corpus import corpus
from ..functions.syntax import UNSUPPORTED
from .oracle import CLASSIFIED, CLEANED, JUDGED, RECORDS, listed, using

UNSUPPORTED_SQL = listed(UNSUPPORTED)
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(clean(corpus(spark, sf_dir)).select("ord", "line", "discard_reason", "was_trimmed"), "clean")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).where("line is not null").select("ord", "line")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(classify(_lines(spark, sf_dir)), "classified")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(staged(route(classify(_lines(spark, sf_dir))), "routed"))


def _compiled(spark: SparkSession, sf_dir: str) -> Compiled:
    """Equal raw lines are cleaned once, and equal clean ones compiled once."""
    raw = corpus(spark, sf_dir).select("ord", "raw")
    different = staged(clean(counted(raw, "raw")).select("raw", "ord", "n", "line"), "clean")
    lines = raw.join(different.where("line is not null").select("raw", "line"), "raw")
    short = different.where("line is not null").select("ord", "n", strip("line").alias("line"))
    return compile_rules(lines.select("ord", "line"), counted(short, "line"))


@query(using(CLEANED, "SELECT ord, t AS line, shorter AS was_trimmed FROM cleaned WHERE discard_reason IS NULL"))
def clean_kept(spark, sf_dir):
    return _cleaned(spark, sf_dir).where("line is not null").select("ord", "line", "was_trimmed")


@query(using(CLEANED, "SELECT discard_reason, count(*)::BIGINT AS n FROM cleaned WHERE discard_reason IS NOT NULL GROUP BY discard_reason"))
def clean_reason_counts(spark, sf_dir):
    return _cleaned(spark, sf_dir).groupBy("discard_reason").agg(F.count("*").alias("n")).where("discard_reason is not null")


@query(using(CLASSIFIED, "SELECT kind, is_exception, count(*)::BIGINT AS n FROM classified GROUP BY kind, is_exception"))
def rule_kinds(spark, sf_dir):
    return classify(_lines(spark, sf_dir)).groupBy("kind", "is_exception").agg(F.count("*").alias("n"))


@query(using(CLASSIFIED, "SELECT ord, effect, scope, reason, docs_source, uncertain FROM classified"))
def rule_effects(spark, sf_dir):
    return classify(_lines(spark, sf_dir)).select("ord", "effect", "scope", "reason", "docs_source", "uncertain")


@query(using(CLASSIFIED, "SELECT effect, uncertain, count(*)::BIGINT AS n FROM classified GROUP BY effect, uncertain"))
def effect_counts(spark, sf_dir):
    return classify(_lines(spark, sf_dir)).groupBy("effect", "uncertain").agg(F.count("*").alias("n"))


@query(using(CLASSIFIED, "SELECT ord, sig, array_to_string(list_sort(mod_names), ',') AS mod_names FROM classified WHERE modifier_text IS NOT NULL"))
def modifier_signatures(spark, sf_dir):
    return _classified(spark, sf_dir).where("modifier_text is not null").select("ord", "sig", F.array_join(F.array_sort("mod_names"), ",").alias("mod_names"))


@query(using(RECORDS, "SELECT ord, tok::BIGINT AS tok, rule, domain FROM records WHERE promoted"))
def domains_promoted(spark, sf_dir):
    return _records(spark, sf_dir).where("promoted").select("ord", F.col("tok").cast("long").alias("tok"), "rule", "domain")


@query(using(RECORDS, "SELECT domain, tld, registered, array_to_string(parents, ',') AS parents FROM suf3"))
def domain_parents(spark, sf_dir):
    domains = _records(spark, sf_dir).where("not is_exception").select("domain").distinct()
    return with_suffix(domains).select("domain", "tld", "registered", F.array_join("parents", ",").alias("parents"))


@query(using(RECORDS, "SELECT ord, tok::BIGINT AS tok, rule, domain, is_wildcard, sig FROM rules WHERE nth = 1"))
def dedup_first_wins(spark, sf_dir):
    return first_wins(_records(spark, sf_dir).where("not is_exception")).where("nth = 1").select("ord", F.col("tok").cast("long").alias("tok"), "rule", "domain", "is_wildcard", "sig")


def _verdict_query(name: str, condition: str):
    oracle = using(JUDGED, f"SELECT ord, tok::BIGINT AS tok, rule, coalesce(sure, maybe)[2]::BIGINT AS by_ord, coalesce(sure, maybe)[3]::BIGINT AS by_tok FROM judged WHERE {condition}")

    def run(spark, sf_dir):
        return _compiled(spark, sf_dir).kept.where(condition).select("o.ord", F.col("o.tok").cast("long").alias("tok"), "rule", F.col("by_o.ord").alias("by_ord"), F.col("by_o.tok").cast("long").alias("by_tok"))

    run.__name__ = name
    query(oracle)(run)


_verdict_query("prune_tld", "verdict = 'tld_wildcard_covered'")
_verdict_query("prune_parent", "verdict = 'parent_covered' AND NOT is_wildcard")
_verdict_query("prune_wildcard", "verdict = 'wildcard_covered'")
_verdict_query("prune_apex", "verdict = 'parent_covered' AND is_wildcard")
_verdict_query("exception_removed", "verdict = 'exception_covered'")


@query(
    using(
        JUDGED,
        """SELECT ord, tok::BIGINT AS tok, rule, coalesce(sure, maybe)[2]::BIGINT AS by_ord, CASE WHEN tld_o IS NOT NULL THEN 'tld_wildcard_modifier_scope_unproven' WHEN maybe[1] = -3 THEN 'exception_domain_scope_matched_modifier_scope_unproven'
  WHEN maybe[1] = -1 THEN 'wildcard_candidate_parent_modifier_scope_unproven' WHEN maybe[1] % 2 = 0 THEN 'parent_modifier_scope_unproven' ELSE 'wildcard_modifier_scope_unproven' END AS detail
FROM judged WHERE verdict = 'kept_because_uncertain'""",
    )
)
def uncertain_kept(spark, sf_dir):
    return _compiled(spark, sf_dir).kept.where("verdict = 'kept_because_uncertain'").select("o.ord", F.col("o.tok").cast("long").alias("tok"), "rule", F.col("by_o.ord").alias("by_ord"), "detail")


OUTPUT_SQL = """SELECT CASE WHEN section = 'tld_wildcard' THEN 0 ELSE 1 END AS section, rule AS line, ord, ko[1] AS key_ord FROM (SELECT *, min([ord, tok]) OVER (PARTITION BY storage_key) AS ko FROM judged) WHERE verdict IS NULL OR verdict = 'kept_because_uncertain'
UNION ALL SELECT 2, line, NULL, NULL FROM others"""


@query(using(JUDGED, f"SELECT section::BIGINT AS section, line, ord, key_ord FROM ({OUTPUT_SQL})"))
def compile_output(spark, sf_dir):
    return _compiled(spark, sf_dir).output().select(F.col("section").cast("long").alias("section"), "line", "o.ord", F.col("key_o.ord").alias("key_ord"))


_n = lambda table, cond: f"(SELECT count(*) FROM {table} WHERE {cond})::BIGINT"
STATS_SQL = f"""SELECT {_n('lines', 'true')} AS total_input,
{', '.join(f"{_n('classified', f"effect = '{e}'" + (' OR uncertain' if e == 'uncertain' else ''))} AS rule_effect_{e}" for e in EFFECTS)},
{_n('routed', "route = 'malformed'")} AS malformed_discarded, {_n('routed', "route = 'nonblocking' AND reason = 'local_hostname_ignored'")} AS local_hostname_pruned,
{_n('rules', 'nth > 1')} + {_n('routed', "route = 'other'")} - {_n('others', 'true')} AS duplicate_pruned,
{_n('rules', 'nth = 1 AND promoted')} AS formats_compressed, {_n('rules', 'nth = 1 AND promoted')} AS compression_policy_broadened,
{_n('judged', "verdict = 'exception_covered'")} AS whitelist_conflict_pruned, {_n('judged', "verdict = 'tld_wildcard_covered'")} AS tld_wildcard_pruned,
{_n('judged', "verdict IN ('parent_covered', 'wildcard_covered')")} AS abp_subdomain_pruned, {_n('judged', "verdict IS NULL OR verdict = 'kept_because_uncertain'")} AS abp_kept,
{_n('others', 'true')} AS other_kept, {_n('others', "kind = 'regex'")} AS regex_preserved_no_pruning,
{_n('judged', "verdict IS NULL OR verdict = 'kept_because_uncertain'")} + {_n('others', 'true')} AS total_output"""


@query(using(JUDGED, STATS_SQL))
def compile_stats(spark, sf_dir):
    return _compiled(spark, sf_dir).stats()


@query(
    using(
        JUDGED,
        f"""SELECT (SELECT count(DISTINCT storage_key) FROM kept WHERE section = 'abp')::BIGINT AS abp_rule_keys, (SELECT count(DISTINCT tld) FROM kept WHERE section = 'tld_wildcard')::BIGINT AS abp_wildcard_keys,
{_n('kept', 'true')} AS duplicate_index_size, (SELECT count(DISTINCT CASE WHEN is_wildcard THEN '*.' || domain ELSE domain END) FROM excs)::BIGINT AS exception_rule_keys, {_n('others', 'true')} AS other_rule_count""",
    )
)
def compile_cardinalities(spark, sf_dir):
    return _compiled(spark, sf_dir).cardinalities()


__all__ = ["QUERIES", "ORACLES", "REASONS"]

from . import more_queries  # noqa: E402, F401
