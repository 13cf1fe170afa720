"""WARC derivatives: metadata and plain-text conversion records built from response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|tr|table|article|section|nav|header|footer|main|aside|body|html|blockquote|pre)\b[^>]*>"
TAGS = r"<[^>]*>"
#: In order, the ampersand last, so that a decoded text isn't decoded again.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _uuid(text: Column) -> Column:
    """A record id made from the MD5 of what names the record (the layout of a version 3 UUID)."""
    h = F.md5(text.cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (page_id, record_id, warc_date, target_uri, http_headers, payload, payload_digest) of fetched pages (page_id, url, html).

    Edge cases: a null html is an empty payload; a null or empty url becomes urn:page:<page_id>, and line ends in a url are
    percent-encoded, as a header can't hold them; repeated rows give repeated records with equal ids; an empty table
    gives an empty result; other columns are ignored. The pages have no date of their own, so all records carry date.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    base = pages.select("page_id", F.coalesce(F.when(F.col("url") != "", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.concat(F.lit("urn:page:"), page)).alias("target_uri"), html.alias("payload"), page.alias("page"))
    return base.select(
        "page_id",
        _uuid(F.concat(F.lit("response "), "page", F.lit(" "), "target_uri")).alias("record_id"),
        F.lit(date).alias("warc_date"),
        "target_uri",
        F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF)).alias("http_headers"),
        "payload",
        _digest(F.col("payload")).alias("payload_digest"),
    )


def plain_text(html: Column) -> Column:
    """The text of a page: hidden parts and tags removed, block tags as line ends, the usual entities decoded."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record.

    Both keep the response's target and date, refer to it by WARC-Refers-To, and carry the digest of its payload;
    the metadata block (application/warc-fields) has its HTTP headers, title, sizes and outlinks, the conversion
    block its plain text. Columns: page_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type,
    content_length, block_digest, source_digest, header, block.

    Edge cases: a null html is an empty payload and gives an empty conversion block; a null or empty url becomes
    urn:page:<page_id>; repeated rows give repeated records with equal ids; an empty table gives an empty result;
    other columns are ignored. Numeric entities other than those in ENTITIES, and tags that are never closed by ">",
    stay as text.
    """
    title = F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"[\r\n]+", " ")
    read = records.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "http_headers", title.alias("title"), F.octet_length("payload").cast("string").alias("size"), F.regexp_extract_all("payload", F.lit(r'(?i)<a\s[^>]*href="([^"\r\n]*)"'), F.lit(1)).alias("links"), plain_text(F.col("payload")).alias("text"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    links = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))))
    about = F.concat(F.lit("via-status: "), F.regexp_replace("http_headers", r"\r\n(?=.)", CRLF + "via-"), field("payload-length", F.col("size")), field("title", F.col("title")), field("outlinks", F.size("links").cast("string")), links)
    both = read.withColumn("about", about).select(
        "page_id",
        "record_id",
        "target_uri",
        "warc_date",
        "payload_digest",
        F.explode(F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.col("about").alias("block")), F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")))).alias("r"),
    )
    made = both.select(
        "page_id",
        "r.warc_type",
        _uuid(F.concat("r.warc_type", F.lit(" of "), "record_id")).alias("new_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        _digest(F.col("r.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"),
        "r.block",
    ).withColumnRenamed("new_id", "record_id")
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.col("warc_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("WARC-Source-Payload-Digest", F.col("source_digest")),
        field("Content-Type", F.col("content_type")),
        field("Content-Length", F.col("content_length").cast("string")),
    )
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", header.alias("header"), "block")


def serialized(derived: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each record as they stand in a WARC file."""
    return derived.select("page_id", F.concat("header", F.lit(CRLF), "block", F.lit(CRLF * 2)).cast("binary").alias("record"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(HIDDEN)}, '', 'g'), {q(BLOCKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(char)})"
    text = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    uuid = lambda x: f"'<urn:uuid:' || md5({x})[1:8] || '-' || md5({x})[9:12] || '-3' || md5({x})[14:16] || '-8' || md5({x})[18:20] || '-' || md5({x})[21:32] || '>'"
    return rf"""
WITH page AS (
  SELECT page_id, coalesce(replace(replace(nullif(url, ''), chr(13), '%0D'), chr(10), '%0A'), 'urn:page:' || coalesce(page_id::VARCHAR, 'null')) AS target_uri,
         coalesce(html, '') AS payload, chr(13) || chr(10) AS nl, coalesce(page_id::VARCHAR, 'null') AS page
  FROM pages
), response AS (
  SELECT *, {uuid("'response ' || page || ' ' || target_uri")} AS response_id,
         regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '[\r\n]+', ' ', 'g') AS title,
         regexp_extract_all(payload, '(?i)<a\s[^>]*href="([^"\r\n]*)"', 1) AS links,
         {text} AS body, strlen(payload)::VARCHAR AS size
  FROM page
), made AS (
  SELECT page_id, 'conversion' AS warc_type, response_id, target_uri, payload, nl, 'text/plain; charset=utf-8' AS content_type, body AS block FROM response
  UNION ALL
  SELECT page_id, 'metadata', response_id, target_uri, payload, nl, 'application/warc-fields',
         'via-status: HTTP/1.1 200 OK' || nl || 'via-Content-Type: text/html; charset=utf-8' || nl || 'via-Content-Length: ' || size || nl
         || 'payload-length: ' || size || nl || 'title: ' || title || nl || 'outlinks: ' || len(links) || nl
         || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || nl), ''), '')
  FROM response
), named AS (
  SELECT *, {uuid("warc_type || ' of ' || response_id")} AS record_id, 'sha256:' || sha256(block) AS block_digest,
         'sha256:' || sha256(payload) AS source_digest, strlen(block)::BIGINT AS content_length FROM made
)
SELECT page_id, warc_type, record_id, response_id AS refers_to, target_uri, '{DATE}' AS warc_date, content_type, content_length, block_digest, source_digest,
       'WARC/1.1' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || response_id || nl
       || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: {DATE}' || nl || 'WARC-Block-Digest: ' || block_digest || nl
       || 'WARC-Source-Payload-Digest: ' || source_digest || nl || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl AS header, block
FROM named"""


ORACLE_SQL = _oracle()
