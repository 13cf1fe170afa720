"""A corpus of filter rules derived from the driver's tables, stated once in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = """SELECT event_id AS ord, event_id % 5 AS src,
  event_type || '.u' || CAST(user_id % 97 AS STRING) || '.' || CASE event_id % 4 WHEN 0 THEN 'shop.co.uk' WHEN 1 THEN 'ads.autos' WHEN 2 THEN 'cdn.example.com' ELSE 'trk.xyz' END AS h,
  CASE event_id % 4 WHEN 0 THEN 'shop.co.uk' WHEN 1 THEN 'ads.autos' WHEN 2 THEN 'cdn.example.com' ELSE 'trk.xyz' END AS parent
FROM events"""
PAGES = "SELECT 1000000000 + page_id AS ord, page_id % 5 AS src, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, 'example.net' AS parent FROM pages"

_TEMPLATES = [
    "'||' || h || '^'",
    "'0.0.0.0 ' || h",
    "h",
    "CASE WHEN ord % 11 = 0 THEN '||*.' || parent || '^' ELSE '||*.x' || CAST(ord % 9 AS STRING) || '.' || parent || '^' END",
    "'@@||' || h || '^'",
    "'||' || h || '^$important'",
    "'||' || h || '^$client=10.0.0.' || CAST(ord % 3 AS STRING)",
    "'||' || h || '^$dnstype=A|AAAA,client=x'",
    "'||' || h || '^$client=x,dnstype=a|aaaa'",
    "'# a comment on ' || h",
    "h || '##.banner'",
    "'||' || h || '/path/x.js'",
    "'||' || h || '^$third-party'",
    "'/re' || CAST(ord % 50 AS STRING) || '[0-9]+' || h || '/'",
    "'||' || h || '^$badfilter'",
    "'||' || h || '^$dnsrewrite=1.2.3.4'",
    "'||' || h || '^$denyallow=a.com'",
    "'  ||' || upper(h) || '^  '",
    "'127.0.0.1 ' || h || ' www.' || h || ' localhost # note'",
    "CASE WHEN ord % 7 = 0 THEN '||' || parent || '^$client=x' ELSE '||u' || CAST(ord % 40 AS STRING) || '.' || parent || '^' END",
    "''",
    "CASE WHEN ord % 5 = 0 THEN '||*.autos^$client=x' ELSE '||' || h || '^$ctag=device_tv' END",
    "CASE WHEN ord % 3 = 0 THEN '@@||*.u' || CAST(ord % 30 AS STRING) || '.' || parent || '^$client=x' ELSE '@@||' || h || '^$important' END",
    "'||' || h || '^$important,client=x'",
    "'||' || h || '^$client=' || chr(39) || 'Frank' || chr(92) || chr(39) || 's, laptop' || chr(39) || '|~tv'",
    "h || '$important'",
    "'localhost'",
    "'||ads*.' || h || '^'",
    "'||' || h || '^$client=a,client=b'",
    "'||' || h || '^ # trailing note'",
    "'@@' || h",
    "'*track' || CAST(ord % 20 AS STRING) || '*'",
    "'||' || h || '^$client='",
    "'||*.' || h || '^'",
]
RAW = "CASE (ord * 7 + src * 3) % " + str(len(_TEMPLATES)) + "".join(f"\n  WHEN {i} THEN {t}" for i, t in enumerate(_TEMPLATES)) + " END"
SQL = f"SELECT CAST(ord AS BIGINT) AS ord, CAST(src AS BIGINT) AS src, h, parent, {RAW} AS raw FROM ({EVENTS} UNION ALL {PAGES}) base"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, src, h, parent, raw): one rule line for every event and every page."""
    def part(name: str, sql: str) -> DataFrame:
        items, _ = sql.split("\nFROM") if "\nFROM" in sql else sql.split(" FROM ")
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*_items(items))

    base = part("events", EVENTS).unionByName(part("pages", PAGES))
    return base.select(F.col("ord").cast("long").alias("ord"), F.col("src").cast("long").alias("src"), "h", "parent", F.expr(RAW).alias("raw"))


def _items(select: str) -> list[str]:
    """The comma-separated items of a SELECT list, commas in brackets and strings aside."""
    text, out, depth, quoted, start = select.removeprefix("SELECT "), [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and depth == 0 and c == ",":
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]]]
