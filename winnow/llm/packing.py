"""Packing: documents into fixed windows by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words_in


def shallow_combinations(bins: int, depth: int = 3) -> np.ndarray:
    """bins x combinations: how often each length 1..bins occurs in every combination of at most depth lengths that fills a window."""
    found: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int, least: int) -> None:
        if len(prefix) < depth and left >= least:
            found.append((*prefix, left))
        if len(prefix) < depth - 1:
            for x in range(least, left // 2 + 1):
                extend((*prefix, x), left - x, x)

    extend((), bins, 1)
    a = np.zeros((bins, len(found)))
    for j, combo in enumerate(found):
        for x in combo:
            a[x - 1, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """The x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(10 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol * scale:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > tol * scale * 1e-3).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= tol * scale * 1e-3
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300))
            x[at] += step * (z - x[at])
            drop = at[(x[at] <= tol * scale * 1e-3) | (bad & (x[at] <= tol * scale))]
            if not len(drop):
                drop = at[bad][:1]
            x[drop] = 0
            passive[drop] = False
    return x


def plan_packs(hist: np.ndarray, depth: int = 3) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: how many}) such that together every piece of the histogram (count of length i at i - 1) is used once.

    The solved repeat counts are rounded and held to what the histogram still has; what is left over is packed
    greedily, longest first, each pack taking the longest pieces that still fit. Both work on counts, so the cost
    depends on the number of lengths and not on the number of pieces.
    """
    bins, left = len(hist), hist.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    if left.sum():
        a = shallow_combinations(bins, depth)
        x = nnls(a, hist / hist.max()) * hist.max()
        for j in np.argsort(-x, kind="stable"):
            if x[j] <= 0:
                break
            used = {int(i) + 1: int(a[i, j]) for i in np.flatnonzero(a[:, j])}
            times = min(int(round(x[j])), *(int(left[i - 1]) // k for i, k in used.items()))
            if times > 0:
                out.append((times, used))
                for i, k in used.items():
                    left[i - 1] -= k * times
    while left.any():
        space, used = bins, {}
        for i in range(bins, 0, -1):
            if i <= space and left[i - 1] and (k := min(space // i, int(left[i - 1]))):
                used[i] = k
                space -= i * k
        times = min(int(left[i - 1]) // k for i, k in used.items())
        out.append((times, used))
        for i, k in used.items():
            left[i - 1] -= k * times
    return out


def pack(docs: DataFrame, window: int = 2048, grid: int = 16, depth: int = 3, rows_per_bucket: int = 50_000) -> DataFrame:
    """(doc_id, chunk, start, n_tokens, pack_id, pack_offset) of every piece of every document of docs (doc_id, text).

    Tokens are white-space separated words. A document longer than the window is cut into whole windows and a rest;
    lengths are rounded up to the grid, so a pack never overflows. Only the histogram (window / grid counts) goes to
    the driver. Pieces get their rank within their length from per-bucket counts, and the plan, whose rows are
    bounded by the number of lengths, turns (length, rank) into a pack by a join.

    Edge cases: a null, empty or blank text has no token and returns one row with chunk 0, n_tokens 0 and a null
    pack; repeated rows are packed once each; an empty table gives an empty result; other columns are ignored.
    """
    if window % grid:
        raise ValueError("grid must divide window")
    spark = docs.sparkSession
    counted = docs.select("doc_id", words_in("text").alias("n"))
    pieces = cut(
        counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / window)).cast("int"))).alias("chunk"))
        .withColumn("n_tokens", F.least(F.lit(window), F.col("n") - F.col("chunk") * window).cast("int"))
        .select("doc_id", "chunk", "n_tokens", F.ceil(F.col("n_tokens") / grid).cast("int").alias("bin")),
        "pieces",
    )
    buckets = max(1, -(-pieces.count() // rows_per_bucket))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(buckets)))
    counts = cut(pieces.where("bin > 0").groupBy("bin", "bucket").agg(F.count("*").alias("c")), "counts")
    hist = np.zeros(window // grid, dtype=np.int64)
    for r in counts.groupBy("bin").agg(F.sum("c").alias("c")).collect():
        hist[r.bin - 1] = r.c

    rows, taken, base = [], np.zeros(len(hist) + 1, dtype=np.int64), 0
    for times, used in plan_packs(hist, depth):
        at = 0
        for i, k in sorted(used.items(), reverse=True):
            rows.append((i, int(taken[i]), int(taken[i]) + k * times, k, base, at))
            taken[i] += k * times
            at += i * k * grid
        base += times
    plan = spark.createDataFrame(rows, "pbin int, lo long, hi long, k int, base long, at int")
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("bin").orderBy("bucket")) - F.col("c")).select(F.col("bin").alias("cbin"), F.col("bucket").alias("cbucket"), "before")
    ranked = pieces.where("bin > 0").withColumn("r", F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("doc_id", "chunk")) - 1)
    ranked = ranked.join(before, (F.col("bin") == F.col("cbin")) & (F.col("bucket") == F.col("cbucket"))).withColumn("rank", F.col("before") + F.col("r"))
    # The plan has at most a few rows for each of the window / grid lengths, however large the input is.
    packed = ranked.join(F.broadcast(plan), (F.col("bin") == F.col("pbin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    since = F.col("rank") - F.col("lo")
    shape = ("doc_id", "chunk", (F.col("chunk") * F.lit(window).cast("long")).alias("start"), "n_tokens")
    return packed.select(*shape, (F.col("base") + F.floor(since / F.col("k"))).alias("pack_id"), (F.col("at") + F.col("bin") * grid * (since % F.col("k"))).cast("int").alias("pack_offset")).union(
        pieces.where("bin = 0").select(*shape, F.lit(None).cast("long"), F.lit(None).cast("int"))
    )
