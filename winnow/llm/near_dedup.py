"""SimHash near-duplicates: an LSH forest over permuted fingerprint bits, groups by verified distance, one document of each kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, nodes_of, other_columns, prefix_for
from .forest import Forest

_NO_ID = -(2**63)


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, check, f0, f1, n_words): text_key, node and check are hashes of the text."""

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text"):
                fp, n = simhash.of_texts(part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(1), part.column(2), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "text_key", "node", "check", "f0", "f1", "n_words"])

    text = F.coalesce("text", F.lit("\0null"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("check"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, text_key long, node long, check long, f0 long, f1 long, n_words long")


def groups(docs: DataFrame, limit: int = 24, target: float = 0.95) -> DataFrame:
    """(doc_id, text_key, group_id, first) for every row of docs (doc_id, text): which group of near duplicates it is in, and whether it stays.

    Two texts are near duplicates if at most limit of the 128 bits of their SimHash differ (24: a cosine of about
    0.83 between their sets of words); groups are connected. The forest's tries over permuted bits are as deep as the texts
    are dense, bucket by bucket, and there are as many as find a pair limit bits apart with chance target, closer pairs more
    often (see Forest). Of each group the row with the least doc_id stays (ties: the text with the least
    hash; null ids last), and of repeated rows the one whose other columns have the least hash.

    Edge cases: null texts are equal to each other; texts without a word are equal only if they are the same;
    repeated rows and exact copies always share a group; an empty table gives an empty result; other columns, whatever their names,
    are ignored.
    """
    base, nodes = nodes_of(cut(_fingerprinted(docs), "fingerprints"), ["f0", "f1", "n_words"])
    label = components(Forest(nodes.where("n_words > 0"), limit, target, least=5, occupancy=128).edges())
    placed = base.select("doc_id", "text_key", "node").join(label, "node", "left").select("doc_id", "text_key", "node", F.coalesce("label", "node").alias("g"))
    # The least of a group is found by a partial aggregate, so that a huge group isn't gathered in one task.
    best = placed.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")).alias("m"))
    return cut(placed.join(best, "g").select("doc_id", "text_key", F.col("g"), F.col("m.doc_id").alias("group_id"), (F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("node") == F.col("m.node"))).alias("first")), "placed")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, group_id, group_size, kept) for every row; see groups() for the parameters and edge cases.

    group_id is the doc_id of the document that stays; of repeated rows of that document one is kept.
    """
    placed = groups(docs, **params)
    sizes = placed.groupBy("g").agg(F.count("*").alias("group_size")).withColumnRenamed("g", "of")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("group_id"))
    ranked = placed.withColumn("kept", F.col("first") & (nth == 1))
    return ranked.join(sizes, F.col("g") == F.col("of")).select("doc_id", "group_id", "group_size", "kept")


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay, all columns as they are; see groups() for the parameters and edge cases."""
    own = prefix_for(docs)
    name = lambda c: F.col(own + c)
    stay = groups(docs, **params).where("first").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(own + "id"), F.col("text_key").alias(own + "key")).distinct()
    keyed = docs.withColumn(own + "a", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(own + "b", F.xxhash64(F.coalesce("text", F.lit("\0null"))))
    kept = keyed.join(stay, (name("a") == name("id")) & (name("b") == name("key")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(own + "a", own + "b").orderBy(other_columns(docs, "doc_id", "text")))
    return kept.withColumn(own + "n", nth).where(name("n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
