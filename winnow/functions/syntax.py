"""What kind of rule a line is, and where its modifiers begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NOT_S, S, col, strip

#: A delimited regular expression at the start: up to the first slash that isn't escaped.
REGEX_HEAD = r"^(?:@@)?/(?:[^/\\]++|\\[\s\S])*+/"
LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
PLAIN_DOMAIN = rf"^{LABEL}(?:\.{LABEL})*$"
HOSTS_LINE = rf"^[\p{{Nd}}.:a-fA-F]+{S}+{NOT_S}"

#: Modifiers that only a browser can follow.
UNSUPPORTED = tuple(
    """1p 3p all app content csp css doc document domain elemhide empty extension first-party font genericblock
    generichide header hls image js jsinject jsonprune match-case media method mp4 network object other
    permissions ping popup redirect redirect-rule removeheader removeparam replace script specifichide
    stealth strict-first-party strict-third-party stylesheet subdocument third-party urlblock webrtc
    websocket xmlhttprequest""".split()
)


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def split_rule(rule: Column) -> tuple[Column, Column]:
    """(pattern, modifier text or null) of a stripped rule; a regular expression keeps what is between its slashes."""
    head = F.regexp_extract(rule, REGEX_HEAD, 0)
    rest = F.substr(rule, F.length(head) + 1)
    after = F.substring_index(rule, "$", -1)
    ends_at_slash = rest.startswith("$")
    cut = F.contains(rule, F.lit("$"))
    pattern = F.when(head != "", F.when(ends_at_slash, head).otherwise(rule)).when(cut, F.substr(rule, F.lit(1), F.length(rule) - F.length(after) - 1)).otherwise(rule)
    text = F.when(head != "", F.when(ends_at_slash, _blank_to_null(F.substr(rest, F.lit(2))))).when(cut, _blank_to_null(after))
    return pattern, text


def naive_names(text: Column) -> Column:
    """Distinct modifier names by plain commas: what the cleaner looks at."""
    def name(part: Column) -> Column:
        n = F.lower(strip(F.substring_index(part, "=", 1)))
        return F.when(n.startswith("~"), F.substr(n, F.lit(2))).otherwise(n)

    return F.coalesce(F.array_distinct(F.filter(F.transform(F.split(text, ","), name), lambda n: n != "")), F.array().cast("array<string>"))


def with_syntax(df: DataFrame, line: str = "line") -> DataFrame:
    """df with pattern, modifier_text, names, is_exception, is_invalid, has_url_path and kind of its stripped lines."""
    df = df.withColumn("_rule", strip(line))
    pattern, text = split_rule(F.col("_rule"))
    df = df.withColumn("pattern", pattern).withColumn("modifier_text", text).drop("_rule")
    p = F.col("pattern")
    df = df.withColumn("is_exception", p.startswith("@@")).withColumn("_candidate", F.when(F.col("is_exception"), F.substr(p, F.lit(3))).otherwise(p))
    c = F.col("_candidate")
    body = F.substr(c, F.lit(3))
    slash, caret = F.instr(body, "/"), F.instr(body, "^")
    is_regex = F.regexp_extract(p, REGEX_HEAD, 0) == p
    df = df.withColumn("names", naive_names(F.col("modifier_text"))).withColumn("_regex", is_regex & (p != "")).withColumn("is_invalid", c.isin("", "||", "||^"))
    path = F.when(F.col("_regex"), False).when(F.contains(c, F.lit("://")), True).when(c.startswith("||"), (slash > 0) & ((caret == 0) | (slash < caret))).otherwise(F.contains(c, F.lit("/")))
    kind = (
        F.when(F.col("is_invalid"), "invalid")
        .when(c.startswith("||"), "abp")
        .when(F.col("_regex"), "regex")
        .when(p.rlike(HOSTS_LINE), "hosts")
        .when(p.rlike(PLAIN_DOMAIN), "plain_domain")
        .otherwise("other")
    )
    return df.withColumn("has_url_path", path).withColumn("kind", kind).drop("_candidate", "_regex")


def is_url_path(line: str | Column) -> Column:
    """has_url_path of a single expression, for use outside with_syntax()."""
    pattern, _ = split_rule(strip(col(line)))
    c = F.regexp_replace(pattern, "^@@", "")
    body = F.substr(c, F.lit(3))
    slash, caret = F.instr(body, "/"), F.instr(body, "^")
    regex = (F.regexp_extract(pattern, REGEX_HEAD, 0) == pattern) & (pattern != "")
    return F.when(regex, False).when(F.contains(c, F.lit("://")), True).when(c.startswith("||"), (slash > 0) & ((caret == 0) | (slash < caret))).otherwise(F.contains(c, F.lit("/")))
