"""White space and small string helpers, as Python's str methods define them, in Column form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() and re's \s take as white space; Java's classes lack some of these.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
S = "[\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NOT_S = "[^" + S[1:]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def tokens(c: str | Column) -> Column:
    """str.split() without arguments."""
    return F.filter(F.split(col(c), S + "+"), lambda x: x != "")


def normalize_domain(c: str | Column) -> Column:
    """Lower case, stripped, without trailing dots."""
    return F.rtrim(strip(F.lower(col(c))), F.lit("."))
