"""Embedding near-duplicates by an inverted multi-index: codebooks on the halves of a vector, whose product is a grid of cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut
from .forest import merged

ROWS_PER_TASK = 100_000


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _square(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def visited(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], count: int) -> np.ndarray:
    """rows x count: the cells (first half's centre * size of the second book + second half's) nearest to each row, in order.

    This is the result of the multi-sequence traversal: among the centres of each half in order of distance, the
    cell of ranks (i, j) is preceded by the (i + 1)(j + 1) - 1 cells of smaller or equal ranks, so only cells with a
    product of at most count can be visited.
    """
    half = x.shape[1] // 2
    near = []
    for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
        d = _square(part, book)
        order = np.argsort(d, axis=1, kind="stable")[:, :count]
        near.append((order, np.take_along_axis(d, order, axis=1)))
    (o1, d1), (o2, d2) = near
    i, j = np.array([(i, j) for i in range(o1.shape[1]) for j in range(min(o2.shape[1], count // (i + 1)))], np.int64).reshape(-1, 2).T
    total = d1[:, i] + d2[:, j]
    best = np.argsort(total, axis=1, kind="stable")[:, :count]
    return o1[np.arange(len(x))[:, None], i[best]].astype(np.int64) * len(books[1]) + o2[np.arange(len(x))[:, None], j[best]]


def drawn(nodes: DataFrame, size: int, count: int) -> np.ndarray:
    """size of the count vectors, those whose id has the least hash; thinned by hash first, so that no more than about twice as many are sent."""
    h = nodes.select("v", F.xxhash64("node").alias("h"))
    share = min(1.0, 2.0 * (size + 50) / max(1, count))
    rows = h.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).orderBy("h").limit(size).collect()
    return np.array([r.v for r in rows], np.float32)


def codebooks(nodes: DataFrame, dim: int, size: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks of size centres, by Lloyd's iterations over all vectors; they begin at size of the vectors."""
    start = drawn(nodes, size, nodes.count()).reshape(-1, dim)
    half = dim // 2
    books = [start[:, :half].copy(), start[:, half:].copy()]
    for _ in range(rounds):
        now = [b.copy() for b in books]

        def sums(batches):
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in now]
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                for lo in range(0, len(x), 4096):
                    for k, part in enumerate((x[lo : lo + 4096, :half], x[lo : lo + 4096, half:])):
                        at = _square(part, now[k]).argmin(axis=1)
                        np.add.at(total[k], at, np.concatenate((part, np.ones((len(part), 1), np.float32)), axis=1))
            for k, t in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k, np.int32)), pa.array(np.arange(len(t), dtype=np.int32)), pa.array(list(t), pa.list_(pa.float64()))], ["book", "centre", "total"])

        found = nodes.select("v").mapInArrow(sums, "book int, centre int, total array<double>").select("book", "centre", F.posexplode("total").alias("at", "x")).groupBy("book", "centre", "at").agg(F.sum("x").alias("x"))
        table = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
        for r in found.collect():
            table[r.book][r.centre, r["at"]] = r.x
        books = [np.where(t[:, -1:] > 0, t[:, :-1] / np.maximum(t[:, -1:], 1), b).astype(np.float32) for t, b in zip(table, books)]
    return books[0], books[1]


def ranks(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """For each row, how many cells lie nearer than the cell of a vector at cosine least from it; the direction is the row's own, its coordinates in another order and sign."""
    half, n = x.shape[1] // 2, len(x)
    rng = np.random.default_rng(3)
    away = x[:, rng.permutation(x.shape[1])] * rng.choice([-1.0, 1.0], x.shape[1]).astype(np.float32)
    away = away - (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    moved = least * x + math.sqrt(max(0.0, 1 - least * least)) * away
    near = [_square(x[:, :half], books[0]).astype(np.float64), _square(x[:, half:], books[1]).astype(np.float64)]
    at = [_square(moved[:, :half], books[0]).argmin(axis=1), _square(moved[:, half:], books[1]).argmin(axis=1)]
    own = near[0][np.arange(n), at[0]] + near[1][np.arange(n), at[1]]
    # All rows' distances to the second book stand in one sorted array, each row in a span of its own.
    apart = 2 * max(float(near[1].max(initial=0)), float(own.max(initial=0))) + 1
    row = np.arange(n)[:, None]
    flat = (np.sort(near[1], axis=1) + row * apart).reshape(-1)
    before = np.searchsorted(flat, np.clip(own[:, None] - near[0], -1e-9, apart - 1e-9) + row * apart) - row * near[1].shape[1]
    return np.clip(before, 0, near[1].shape[1]).sum(axis=1)


def cells_for(nodes: DataFrame, dim: int, books: tuple[np.ndarray, np.ndarray], least: float, target: float) -> int:
    """How many cells a query must visit so that the share target of all vectors meets the cell of a vector at cosine least (see ranks()).

    Counted over all nodes; ranks beyond 1,024 are rounded up by 12 %, so that the counts that come to the driver are few.
    """

    def count(batches):
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for lo in range(0, len(x), 1000):
                r = ranks(x[lo : lo + 1000], books, least)
                r = np.where(r < 1024, r, np.ceil(1.12 ** np.ceil(np.log(np.maximum(r, 1)) / math.log(1.12))).astype(np.int64))
                rank, n = np.unique(r, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int64)), pa.array(n.astype(np.int64))], ["rank", "n"])

    found = sorted((r["rank"], r["n"]) for r in nodes.select("v").mapInArrow(count, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect())
    need, most = target * sum(n for _, n in found), len(books[0]) * len(books[1])
    met = 0
    for rank, n in found:
        met += n
        if met >= need:
            return min(most, rank + 1)
    return 1


def cell_edges(cell: np.ndarray, query: np.ndarray, row: np.ndarray, x: np.ndarray, least: float, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of entries in the same cell, i a query and j a member, of cosine least or more: enough to join all such into groups."""
    order = np.lexsort((query, cell))
    cell, query, x = cell[order], query[order], x[order]
    found = []
    bound = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else np.zeros(0, np.int64)
    row = row[order]
    for a, b in zip(bound[:-1], bound[1:]):
        m = a + int((~query[a:b]).sum())
        if m == a or m == b:
            continue
        label = np.arange(b - a)
        width = max(1, block // (m - a))
        for q in range(m, b, width):
            r = min(b, q + width)
            i, j = np.nonzero(x[q:r] @ x[a:m].T >= least)
            i, j = i + q - a, j
            other = row[i + a] != row[j + a]
            i, j = i[other], j[other]
            if len(i):
                i, j, label = merged(i, j, label)
                found.append((order[i + a], order[j + a]))
    if not found:
        return order[:0], order[:0]
    return tuple(np.concatenate(f) for f in zip(*found))


def near_duplicates(table: DataFrame, least: float = 0.9, target: float = 0.95, occupancy: int = 64) -> DataFrame:
    """(vec_id, group_id, group_size, kept) for every row of table (vec_id, embedding).

    Two vectors are near duplicates if their cosine is at least least; groups are connected, and the row with the
    least vec_id of each stays. Vectors are put in the cell of their nearest centres; the books grow with the square
    root of the number of vectors, so that a cell holds about occupancy. Every vector is a query and visits its
    nearest cells, as many as meet a vector at just that cosine with chance target (measured on all vectors,
    each moved by that angle), and every cosine in a cell is computed.

    Edge cases: equal vectors are one node and always share a group; a null, empty or zero vector, one with a null
    or NaN, or one whose length isn't the most frequent one, stands alone; ties go to the least id; repeated rows
    share a group, one stays; an empty table gives an empty result; other columns are ignored.
    """
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    lengths = base.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 2
    norm = F.aggregate("v", F.lit(0.0), lambda s, a: s + F.coalesce(a.cast("double"), F.lit(float("nan"))) * a)
    good = (F.size("v") == dim) & (F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))
    rows = cut(base.withColumn("norm", norm).withColumn("good", F.coalesce(good, F.lit(False))).select("vec_id", "good", F.when(F.col("good"), F.xxhash64("v")).alias("node"), F.when(F.col("good"), F.transform("v", lambda a: (a / F.sqrt("norm")).cast("float"))).alias("v")), "vectors")
    nodes = cut(rows.where("good").groupBy("node").agg(F.first("v").alias("v")), "vector-nodes")
    count = nodes.count()
    edges = None
    if count > 1:
        size = max(1, min(count, math.ceil(math.sqrt(count / occupancy))))
        books = codebooks(nodes, dim, size)
        cells = cells_for(nodes, dim, books, least, target)

        def spread(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    at = visited(_matrix(part.column(1), dim), books, cells)
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(np.zeros(len(at), bool)), *part.columns], ["cell", "query", "node", "v"])
                    for k in range(at.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(at[:, k]), pa.array(np.ones(len(at), bool)), *part.columns], ["cell", "query", "node", "v"])

        def match(batches):
            parts = [p for p in batches if p.num_rows]
            if not parts:
                return
            cell, query, node = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(3))
            x = np.concatenate([_matrix(p.column(3), dim) for p in parts])
            i, j = cell_edges(cell, query.astype(bool), node, x, least)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

        tasks = max(1, -(-count * (cells + 1) // ROWS_PER_TASK))
        edges = nodes.select("node", "v").mapInArrow(spread, "cell long, query boolean, node long, v array<float>").repartition(tasks, "cell").mapInArrow(match, "a long, b long").distinct()
    else:
        edges = table.sparkSession.createDataFrame([], "a long, b long")
    label = components(edges)
    # What stands alone gets a group of its own, kept apart from the others by its kind.
    lone = F.when(~F.col("good"), F.xxhash64(F.lit("alone"), F.coalesce("vec_id", F.lit(-1))))
    placed = rows.select("vec_id", "good", "node").join(label, "node", "left").select("vec_id", "good", "node", F.coalesce(lone, "label", "node").alias("g"))
    best = placed.groupBy("good", "g").agg(F.min("vec_id").alias("group_id"), F.count("*").alias("group_size"))
    joined = placed.join(best, ["good", "g"])
    nth = F.row_number().over(Window.partitionBy("good", "g", "vec_id").orderBy("node"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("group_id")) & (nth == 1)).select("vec_id", "group_id", "group_size", "kept")
