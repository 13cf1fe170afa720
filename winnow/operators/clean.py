"""Cleaning: every raw line is kept in its short form or discarded for one reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.syntax import UNSUPPORTED, with_syntax
from ..functions.text import S, strip

COSMETIC = r"(?i)#[@$?%]*#|\$#|\[adblock"
TRAILING = rf"{S}+#{S}+[^\n]*$"
REASONS = ("comment", "cosmetic", "unsupported_modifier", "empty", "url_path", "invalid")
#: The stage of the report that a reason belongs to.
STAGE_OF = {"empty": "prefilter", "comment": "prefilter", "cosmetic": "compatibility", "unsupported_modifier": "compatibility", "url_path": "compatibility", "invalid": "syntax"}


def without_trailing_comment(line):
    """A line without " # ..."; a # after the last $ may belong to a modifier and stays."""
    keep = F.contains(line, F.lit("$")) & F.contains(F.substring_index(line, "$", -1), F.lit("#"))
    return F.when(keep, line).otherwise(F.when(line.rlike(TRAILING), F.rtrim(F.regexp_replace(line, TRAILING, ""), F.lit(" \t\n\x0b\f\r"))).otherwise(line))


def clean(df: DataFrame, had_newline: str | None = None) -> DataFrame:
    """df (raw) with line (null if discarded), discard_reason and was_trimmed; the tests run in a fixed order and the first counts.

    Write the result before filtering on it: a filter is pushed down to the scan with its whole expression.

    had_newline names a boolean column: a line end that the reader removed counts as trimmed.
    """
    keep = df.columns
    out = df.withColumn("_s", strip("raw"))
    out = out.withColumn("_t", without_trailing_comment(F.col("_s")))
    out = with_syntax(out.withColumn("_line", F.col("_t")), "_line")
    s = F.col("_s")
    reason = (
        F.when(s == "", "empty")
        .when(s.startswith("#") | s.startswith("!"), "comment")
        .when(s.rlike(COSMETIC), "cosmetic")
        .when(F.arrays_overlap("names", F.array(*map(F.lit, UNSUPPORTED))), "unsupported_modifier")
        .when(F.col("has_url_path"), "url_path")
        .when(F.col("is_invalid"), "invalid")
    )
    trimmed = (F.length(s) != F.length("raw")) | (F.length("_t") != F.length(s))
    if had_newline:
        trimmed = trimmed | F.col(had_newline)
    out = out.withColumn("discard_reason", reason)
    return out.select(*keep, F.when(F.col("discard_reason").isNull(), F.col("_t")).alias("line"), "discard_reason", (F.col("discard_reason").isNull() & trimmed).alias("was_trimmed"))


def clean_stats(cleaned: DataFrame) -> DataFrame:
    """One row: lines_raw, lines_clean, trimmed, and a count for each reason."""
    return cleaned.agg(
        F.count("*").alias("lines_raw"),
        F.count_if(F.col("discard_reason").isNull()).alias("lines_clean"),
        F.count_if("was_trimmed").alias("trimmed"),
        *[F.count_if(F.col("discard_reason") == r).alias(f"{r}_removed") for r in REASONS],
    )


def clean_stages(stats: dict) -> dict:
    """Processed, emitted and discarded of each cleaning stage, from clean_stats(); only reasons that occurred are listed."""
    out = {stage: {"processed": 0, "emitted": 0, "discarded": 0, "reasons": {}} for stage in ("normalize", "prefilter", "compatibility", "syntax", "emit")}
    for stage, reason, key, kind in [("normalize", "trimmed", "trimmed", "emitted"), *((STAGE_OF[r], r, f"{r}_removed", "discarded") for r in REASONS), ("emit", "kept", "lines_clean", "emitted")]:
        if n := int(stats.get(key) or 0):
            row = out[stage]
            row["processed"] += n
            row[kind] += n
            row["reasons"][reason] = n
    return out
