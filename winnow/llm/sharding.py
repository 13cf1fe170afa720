"""Sharding: groups of documents into shards by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, words_in

DIMS = ("bytes", "tokens", "n_rows")


def pack_groups(sizes: np.ndarray, n_bins: int, slack: float = 0.02) -> np.ndarray:
    """The bin of each row of sizes (groups x dimensions), largest group first, ties by position.

    Each group goes where the dot product of its size with the residual capacity is highest among the bins that
    hold it in every dimension; where none does, among all bins. Ties go to the first bin.
    """
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * n_bins
    room = np.full((n_bins, sizes.shape[1]), 1.0 + slack)
    out = np.zeros(len(sizes), dtype=np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        gain = room @ share[k]
        fits = (room >= share[k]).all(axis=1)
        out[k] = int(np.argmax(np.where(fits, gain, -np.inf))) if fits.any() else int(np.argmax(gain))
        room[out[k]] -= share[k]
    return out


def shard(docs: DataFrame, target_bytes: int = 32 << 20, groups_per_shard: int = 16, shards_per_block: int = 64) -> DataFrame:
    """(doc_id, source, part, shard, bytes, tokens) for every row of docs (doc_id, text, source).

    A group is a source, or where a source outgrows target_bytes / groups_per_shard, one of its hash parts, so a hot
    source is spread. Groups fall by hash into blocks of about shards_per_block shards, each packed on its own in
    parallel: the sequential placement is bounded by the block, never by the input, and one block serves a small input.

    Edge cases: a null or empty text has 0 bytes and 0 tokens but counts as a row; a null source is a source of its
    own; repeated rows stay together (equal ids share a part) and each is returned; an empty table gives an empty
    result; other columns are ignored. A document longer than a shard gets a shard that is over its share.
    """
    rows = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
            words_in("text").alias("tokens"),
        ),
        "sizes",
    )
    per_group = max(1, target_bytes // groups_per_shard)
    sources = rows.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / per_group)).cast("long").alias("parts"))
    split = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).drop("s", "parts")
    groups = cut(split.groupBy("source", "part").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, round(math.ceil(total / target_bytes) / shards_per_block))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "part"], na_position="first", kind="stable").reset_index(drop=True)
        n = max(1, math.ceil(pdf["bytes"].sum() / target_bytes))
        base = int(pdf["block"].iloc[0]) * 1_000_000
        return pd.DataFrame({"source": pdf["source"], "part": pdf["part"], "shard": base + pack_groups(pdf[list(DIMS)].to_numpy(float), n)})

    placed = groups.withColumn("block", F.pmod(F.xxhash64("source", "part"), F.lit(blocks))).groupBy("block").applyInPandas(place, "source string, part long, shard long")
    placed = placed.toDF("s", "p", "shard")
    return split.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "part", "shard", "bytes", "tokens")
