"""Modifiers of a rule: parsing with quotes and escapes, signatures, and when one rule's scope covers another's.

Quotes and escapes are a regular language, so the parse is an expression of built-in functions and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

VALUED = tuple("dnstype ctag client dnsrewrite denyallow".split())
FLAGS = tuple("important badfilter".split())
KNOWN = VALUED + FLAGS
SCOPED = tuple(m for m in VALUED if m != "dnsrewrite")
SPECIAL = tuple("denyallow badfilter dnsrewrite".split())

_ATOM = r"""\\[\s\S]|\\$|'(?:[^'\\]++|\\[\s\S])*+(?:'|\\?$)|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?$)"""
_BALANCED = r"""^(?:[^'"\\]++|\\[\s\S]|'(?:[^'\\]++|\\[\s\S])*+'|"(?:[^"\\]++|\\[\s\S])*+")*+$"""


def split_quoted(text: Column, separator: str) -> Column:
    """The parts of text between separators that stand outside quotes and aren't escaped."""
    chunk = rf"""{separator}((?:[^'"\\{separator}]++|{_ATOM})*+)"""
    return F.regexp_extract_all(F.concat(F.lit(separator.replace("\\", "")), text), F.lit(chunk), F.lit(1))


def unbalanced(text: Column) -> Column:
    """Whether a quote stays open or the text ends in an escape."""
    return ~text.rlike(_BALANCED)


def _value(name: Column, raw: Column) -> Column:
    """A value without matching outer quotes and escapes; record types in upper case."""
    quoted = (F.length(raw) >= 2) & F.substr(raw, F.lit(1), F.lit(1)).isin("'", '"') & (F.substr(raw, F.lit(1), F.lit(1)) == F.substr(raw, F.length(raw), F.lit(1)))
    bare = F.regexp_replace(F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw), r"\\([\s\S])", "$1")
    return F.when(name == "dnstype", F.upper(bare)).otherwise(bare)


def parse(text: Column) -> Column:
    """array<struct<name, raw, raw_value, values: array<struct<raw, value, negated>>, negated, uncertain>> of a modifier text; null gives an empty array."""
    loose = unbalanced(text)

    def named(chunk: Column) -> Column:
        raw = strip(chunk)
        head = F.lower(strip(F.substring_index(raw, "=", 1)))
        negated = head.startswith("~")
        return F.struct(
            F.when(negated, strip(F.substr(head, F.lit(2)))).otherwise(head).alias("name"),
            raw.alias("raw"),
            F.when(F.contains(raw, F.lit("=")), F.substr(raw, F.instr(raw, "=") + 1)).alias("raw_value"),
            negated.alias("negated"),
        )

    def valued(m: Column) -> Column:
        def one(part: Column) -> Column:
            raw = strip(part)
            negated = raw.startswith("~")
            bare = F.when(negated, F.substr(raw, F.lit(2))).otherwise(raw)
            return F.struct(raw.alias("raw"), _value(m["name"], bare).alias("value"), negated.alias("negated"), (bare == "").alias("blank"))

        values = F.coalesce(F.transform(split_quoted(m["raw_value"], r"\|"), one), F.array().cast("array<struct<raw:string,value:string,negated:boolean,blank:boolean>>"))
        given = m["raw_value"].isNotNull()
        uncertain = (
            loose
            | ~m["name"].isin(*KNOWN)
            | (~given & m["name"].isin(*VALUED))
            | (given & (m["name"].isin(*FLAGS) | unbalanced(m["raw_value"]) | F.exists(values, lambda v: v["blank"])))
        )
        plain = F.transform(values, lambda v: F.struct(v["raw"].alias("raw"), v["value"].alias("value"), v["negated"].alias("negated")))
        return F.struct(m["name"].alias("name"), m["raw"].alias("raw"), m["raw_value"].alias("raw_value"), plain.alias("values"), m["negated"].alias("negated"), F.coalesce(uncertain, F.lit(True)).alias("uncertain"))

    parsed = F.transform(F.transform(split_quoted(text, ","), named), valued)
    return F.coalesce(parsed, F.array().cast("array<struct<name:string,raw:string,raw_value:string,values:array<struct<raw:string,value:string,negated:boolean>>,negated:boolean,uncertain:boolean>>"))


def _values_text(m: Column) -> Column:
    """A modifier's values, their negation and its own in one string; the order of values counts."""
    return F.concat(m["negated"].cast("string"), F.array_join(F.transform(m["values"], lambda v: F.concat(F.lit("\x02"), v["negated"].cast("string"), F.lit("\x03"), v["value"])), ""))


def signature(mods: Column) -> Column:
    """One string for what the modifiers mean, in any order: equal strings are equal behaviour; uncertain ones carry their text."""
    return F.array_join(
        F.array_sort(F.transform(mods, lambda m: F.concat(m["name"], F.lit("\x01"), m["raw_value"].isNotNull().cast("string"), F.lit("\x01"), _values_text(m), F.lit("\x01"), F.when(m["uncertain"], F.concat(F.lit("?"), m["raw"])).otherwise("")))),
        "\x04",
    )


def signature_parts(mods: Column) -> Column:
    """The signature as sorted structs (name, negated, given, values, uncertain, raw if uncertain), for reports."""

    def one(m: Column) -> Column:
        values = F.transform(m["values"], lambda v: F.struct(v["value"].alias("value"), v["negated"].alias("negated")))
        return F.struct(m["name"].alias("name"), m["negated"].alias("negated"), m["raw_value"].isNotNull().alias("given"), values.alias("values"), m["uncertain"].alias("uncertain"), F.when(m["uncertain"], m["raw"]).otherwise("").alias("raw"))

    return F.array_sort(F.transform(mods, one))


def _no_cover(mods: Column) -> Column:
    names = F.filter(F.transform(mods, lambda m: m["name"]), lambda n: n != "")
    return F.exists(mods, lambda m: m["uncertain"]) | (F.size(names) != F.size(F.array_distinct(names))) | F.exists(names, lambda n: ~n.isin(*KNOWN) | n.isin(*SPECIAL))


def scope_columns(mods: Column) -> dict[str, Column]:
    """What covers() needs of a rule: columns m_* with, and x_* without, the priority modifier."""
    rest = F.filter(mods, lambda m: m["name"] != "important")
    urgent = F.filter(mods, lambda m: m["name"] == "important")
    first = lambda name: F.get(F.transform(F.filter(mods, lambda m: m["name"] == name), _values_text), F.lit(0))
    fine = F.exists(urgent, lambda m: ~m["negated"] & ~m["uncertain"] & m["raw_value"].isNull())
    return {
        "m_none": F.size(mods) == 0,
        "m_never": _no_cover(mods),
        "x_none": F.size(rest) == 0,
        "x_never": _no_cover(rest),
        "m_important": first("important"),
        "m_client": first("client"),
        "m_ctag": first("ctag"),
        "m_dnstype": first("dnstype"),
        "x_urgent": (F.size(urgent) == 1) & fine,
        "x_safe": (F.size(urgent) == 0) | ((F.size(urgent) == 1) & fine),
    }


SCOPE_COLUMNS = ("m_none", "m_never", "x_none", "x_never", "m_important", "m_client", "m_ctag", "m_dnstype", "x_urgent", "x_safe")


def _narrow(parent, child) -> Column:
    out = F.lit(True)
    for c in ("m_client", "m_ctag", "m_dnstype"):
        out = out & (parent(c).isNull() | F.coalesce(parent(c) == child(c), F.lit(False)))
    return out


def covers(parent, child) -> Column:
    """Whether the parent's modifiers are proven as broad as the child's; both give a column by its name in scope_columns()."""
    return (parent("m_none") & child("m_none")) | (~parent("m_never") & ~child("m_never") & parent("m_important").eqNullSafe(child("m_important")) & _narrow(parent, child))


def exception_covers(exception, block) -> Column:
    """The same for an exception: priority is compared by itself, an urgent block needing an urgent exception."""
    rest = (exception("x_none") & block("x_none")) | (~exception("x_never") & ~block("x_never") & _narrow(exception, block))
    return exception("x_safe") & block("x_safe") & (~block("x_urgent") | exception("x_urgent")) & rest


def with_modifiers(df: DataFrame) -> DataFrame:
    """df with mods, mod_names (distinct) and sig of its modifier_text."""
    df = df.withColumn("mods", parse(F.col("modifier_text")))
    return df.withColumn("mod_names", F.array_distinct(F.filter(F.transform("mods", lambda m: m["name"]), lambda n: n != ""))).withColumn("sig", signature(F.col("mods")))


def names_cover(child: Column, parent: Column) -> Column:
    """The older test by names alone: may a rule with the child's modifier names go if one with the parent's stays?

    Two bare rules: yes. Otherwise neither may have special behaviour, an important child needs an important
    parent, and a parent that is narrowed to clients, tags or record types proves nothing.
    """
    special = F.array(*map(F.lit, SPECIAL))
    narrow = F.array(*map(F.lit, ("client", "ctag", "dnstype")))
    none = (F.size(child) == 0) & (F.size(parent) == 0)
    ok = ~F.arrays_overlap(child, special) & ~F.arrays_overlap(parent, special) & ~F.arrays_overlap(parent, narrow)
    return none | (ok & (~F.array_contains(child, "important") | F.array_contains(parent, "important")))
