"""Public suffixes: the suffix, registered domain and ancestors of a domain.

The list has a fixed size, and a suffix at most a few labels, so a domain is resolved by one broadcast hash join for
each number of labels. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import glob
import hashlib
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACKS = ("/usr/share/publicsuffix/public_suffix_list.dat",)


#: Setting of the session that names a list of one's own; results depend on the list, so it can be fixed.
SETTING = "spark.winnow.publicSuffixList"


@functools.lru_cache(maxsize=4)
def list_text(path: str | None = None) -> str:
    """The public suffix list at path, or, without one, that of Spark's jars."""
    import pyspark

    if path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    for jar in glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "hadoop-client-runtime*.jar")):
        with zipfile.ZipFile(jar) as z:
            if "mozilla/public-suffix-list.txt" in z.namelist():
                return z.read("mozilla/public-suffix-list.txt").decode("utf-8")
    for path in FALLBACKS:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
    raise FileNotFoundError("no public suffix list")


def _path(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None)


def list_digest(spark: SparkSession) -> str:
    """SHA-256 of the list in use, which statistics carry."""
    return hashlib.sha256(list_text(_path(spark)).encode("utf-8")).hexdigest()


@functools.lru_cache(maxsize=4)
def rules(path: str | None = None) -> tuple[tuple[str, bool, bool, bool], ...]:
    """(labels, is a suffix, has a wildcard below, is an exception) of the ICANN section of the list."""
    text = list_text(path)
    found: dict[str, list[bool]] = {}
    inside = False
    for line in text.splitlines():
        if "===BEGIN ICANN DOMAINS===" in line:
            inside = True
        elif "===END ICANN DOMAINS===" in line:
            inside = False
        elif inside and line.strip() and not line.startswith("//"):
            rule = line.split()[0]
            kind = 2 if rule.startswith("!") else 1 if rule.startswith("*.") else 0
            name = rule[(0, 2, 1)[kind] :]
            forms = {name}
            if not name.isascii():
                forms.add(".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split(".")))
            for form in forms:
                found.setdefault(form, [False, False, False])[kind] = True
    return tuple((k, *v) for k, v in sorted(found.items()))


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules(_path(spark))), "x string, exact boolean, wild boolean, negated boolean")


def last_labels(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def with_suffix(df: DataFrame, domain: str = "domain") -> DataFrame:
    """df with tld, registered (null where there is none) and parents (nearest first, ending at the registered domain) of a normalised domain."""
    depth = max(r[0].count(".") + 1 for r in rules(_path(df.sparkSession)))
    known = F.broadcast(table(df.sparkSession))
    out = df.withColumn("_labels", F.split(domain, "[.]")).withColumn("_n", F.size("_labels"))
    best = []
    for k in range(1, depth + 1):
        mine = known.select(*[F.col(c).alias(f"_{c}{k}") for c in known.columns])
        # A domain with fewer labels gets a null key, which joins nothing.
        key = F.when(F.col("_n") >= k, last_labels(F.col("_labels"), F.lit(k)))
        out = out.withColumn(f"_k{k}", key).join(mine, F.col(f"_k{k}") == F.col(f"_x{k}"), "left")
        best.append(F.when(F.col(f"_negated{k}"), 100 + k - 1))
        best.append(F.when(F.col(f"_wild{k}") & (F.col("_n") > k), k + 1))
        best.append(F.when(F.col(f"_exact{k}"), F.lit(k)))
    # An exception overrides everything else; otherwise the longest rule counts.
    out = out.withColumn("_s", F.greatest(*best)).withColumn("_s", F.when(F.col("_s") >= 100, F.col("_s") - 100).otherwise(F.col("_s")))
    out = out.withColumn("_below", F.col("_n") - F.col("_s") - 1)
    parents = F.when(
        F.col("_below") >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("_below"), F.lit(1))), lambda i: last_labels(F.col("_labels"), F.col("_n") - i))
    ).otherwise(F.array().cast("array<string>"))
    return out.withColumn("tld", last_labels(F.col("_labels"), F.col("_s"))).withColumn("registered", F.when(F.col("_below") >= 0, last_labels(F.col("_labels"), F.col("_s") + 1))).withColumn("parents", parents).select(*df.columns, "tld", "registered", "parents")


def domain_shape(domain: Column, is_wildcard: Column) -> Column:
    """none, tld_wildcard, wildcard, subdomain, registered_domain, tld or apex, of a frame with with_suffix()'s columns."""
    return (
        F.when(domain == "", "none")
        .when(is_wildcard & (F.col("tld") == domain), "tld_wildcard")
        .when(is_wildcard, "wildcard")
        .when(F.size("parents") > 0, "subdomain")
        .when(F.col("registered") == domain, "registered_domain")
        .when(F.col("tld") == domain, "tld")
        .otherwise("apex")
    )
