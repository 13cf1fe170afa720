"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from . import digest, html_crf, langid, line_dedup, near_dedup, packing, pieces, sharding, vectors, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark, sf_dir):
    return pieces.encode(_table(spark, sf_dir, "documents"), decoded=True)


def op2_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_lines(spark, sf_dir):
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


def op6_simhash(spark, sf_dir):
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_vectors(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_html(spark, sf_dir):
    return html_crf.extract(_table(spark, sf_dir, "pages"))


def op9_langid(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_digest(spark, sf_dir):
    return digest.fingerprints(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pieces, op2_sharding, op3_packing, op4_lines, op5_warc, op6_simhash, op7_vectors, op8_html, op9_langid, op10_digest)}
ORACLES: dict[str, str] = {"op5_warc": warc.ORACLE_SQL}
