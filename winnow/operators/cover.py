"""Which rules another rule makes redundant: one hierarchical join against the whole index, and its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.modifiers import SCOPE_COLUMNS, covers, exception_covers

#: Where a covering rule stands, in the order in which it is looked for. Ancestors follow: 2 * level, the wildcard of a level one later.
EXCEPTION, TLD, APEX = -3, -2, -1


#: Rules up to which suffix wildcards, or exceptions, are sent to all tasks (some 30 MB) instead of shuffling every rule's keys for them.
SENT = 200_000


def targets(rules: DataFrame, exceptions: DataFrame) -> dict[str, DataFrame]:
    """What a rule can be covered by, under the key it is looked up by: rules of the index, suffix wildcards and exceptions.

    Only the first counts of those that can't be told apart under a key, so a popular one isn't joined as often as it is repeated.
    """
    scope = [F.col(c).alias(f"t_{c}") for c in SCOPE_COLUMNS]
    same = ("key", "t_wild", *[f"t_{c}" for c in SCOPE_COLUMNS])
    found = lambda df, key, o, wild: df.select(F.col(key).alias("key"), o.alias("t_o"), wild.alias("t_wild"), *scope).groupBy(*same).agg(F.min("t_o").alias("t_o"))
    suffix = F.col("section") == "tld_wildcard"
    return {
        "rule": found(rules.where(~suffix), "storage_key", F.col("o"), F.lit(False)),
        "suffix": found(rules.where(suffix), "tld", F.col("o"), F.lit(False)),
        "exception": found(exceptions, "domain", F.struct("ord", "tok"), F.col("is_wildcard")),
    }


def probes(rules: DataFrame, kind: str) -> DataFrame:
    """(o, is_wildcard, scope columns, place, key, own): every key under which something of a kind of targets() might cover a rule."""
    p = F.col("parents")
    at = lambda place, key, own=False: F.struct((F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), key.alias("key"), F.lit(own).alias("own"))
    none = F.array().cast("array<struct<place:int,key:string,own:boolean>>")
    if kind == "exception":
        keys = F.concat(F.array(at(EXCEPTION, F.col("domain"), True)), F.transform(p, lambda d: at(EXCEPTION, d)))
    elif kind == "suffix":
        rules = rules.where((F.col("section") == "abp") & (F.col("tld") != F.col("domain")))
        keys = F.array(at(TLD, F.col("tld")))
    else:
        rules = rules.where("section = 'abp' and (is_wildcard or size(parents) > 0)")
        level = F.transform(p, lambda d, i: F.array(at(2 * i, d), at(2 * i + 1, F.concat(F.lit("*."), d))))
        keys = F.concat(F.when(F.col("is_wildcard"), F.array(at(APEX, F.col("domain")))).otherwise(none), F.flatten(level))
    return rules.select("o", "is_wildcard", *SCOPE_COLUMNS, F.explode(keys).alias("k")).select("o", "is_wildcard", *SCOPE_COLUMNS, "k.*")


def hits(rules: DataFrame, exceptions: DataFrame, sent: int = SENT) -> DataFrame:
    """probes() joined with targets(). Suffix wildcards and exceptions are few beside the rules; up to sent of them are broadcast, more are joined by key as the rules are, with the same rows."""
    out = None
    for kind, found in targets(rules, exceptions).items():
        small = kind != "rule" and found.limit(sent + 1).count() <= sent
        part = probes(rules, kind).join(F.broadcast(found) if small else found, "key")
        out = part if out is None else out.unionByName(part)
    return out


def judged(rules: DataFrame, exceptions: DataFrame) -> DataFrame:
    """rules with verdict (null if nothing covers or might cover it), by_o (the covering rule's position) and by_exception.

    verdict: exception_covered, tld_wildcard_covered, parent_covered, wildcard_covered, or kept_because_uncertain, where a
    rule stands in the right place but its modifiers aren't proven as broad. The index isn't pruned first: a rule that
    goes itself still covers others, so one join is enough.
    """
    hit = hits(rules, exceptions)
    child = lambda c: F.col(c)
    target = lambda c: F.col(f"t_{c}")
    is_exception = F.col("place") == EXCEPTION
    # A wildcard exception reaches the domain itself only if the rule is a wildcard as well.
    hit = hit.where(~(is_exception & F.col("t_wild") & F.col("own") & ~F.col("is_wildcard")))
    hit = hit.withColumn("ok", F.when(is_exception, exception_covers(target, child)).otherwise(covers(target, child)))
    # What may only be covered in part is looked for in the same order, but the last domain-scope match of a TLD counts after exceptions.
    found = hit.groupBy("o").agg(
        F.min(F.when(F.col("ok"), F.struct("place", "t_o"))).alias("sure"),
        F.min(F.when(~F.col("ok"), F.struct("place", "t_o"))).alias("maybe"),
        F.min(F.when(F.col("place") == TLD, F.col("t_o"))).alias("tld_o"),
    )
    out = rules.join(found, "o", "left")
    place, maybe = F.col("sure.place"), F.col("maybe.place")
    verdict = (
        F.when(place == EXCEPTION, "exception_covered")
        .when(place == TLD, "tld_wildcard_covered")
        .when((place == APEX) | (place % 2 == 0), "parent_covered")
        .when(place.isNotNull(), "wildcard_covered")
        .when(maybe.isNotNull(), "kept_because_uncertain")
    )
    detail = (
        F.when(F.col("tld_o").isNotNull(), "tld_wildcard_modifier_scope_unproven")
        .when(maybe == EXCEPTION, "exception_domain_scope_matched_modifier_scope_unproven")
        .when(maybe == APEX, "wildcard_candidate_parent_modifier_scope_unproven")
        .when(maybe % 2 == 0, "parent_modifier_scope_unproven")
        .otherwise("wildcard_modifier_scope_unproven")
    )
    out = out.withColumn("verdict", F.when((F.col("section") == "abp") | (place == EXCEPTION), verdict))
    uncertain = F.col("verdict") == "kept_because_uncertain"
    return (
        out.withColumn("by_o", F.when(F.col("verdict").isNotNull(), F.coalesce("sure.t_o", "maybe.t_o")))
        .withColumn("by_exception", F.when(F.col("verdict").isNotNull(), F.coalesce(place, maybe) == EXCEPTION))
        .withColumn("detail", F.when(uncertain, detail))
        .drop("sure", "maybe", "tld_o")
    )
