"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised bit overlap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, discard, linked

WINDOW = 64
LEVELS = 1001
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Windows of less entropy (of 1000) are runs and repetitions, which many texts share by chance.
LEAST_ENTROPY = 100
POPULAR = 16
_F = np.round([0 if c == 0 else -(c / WINDOW) * math.log2(c / WINDOW) * (1 << 20) for c in range(WINDOW + 1)]).astype(np.int32)
_GAIN = np.diff(_F)
COUNTERS = 1 << 20


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of the texts, nulls as empty."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2], dtype=np.uint8) if plain.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of the WINDOW bytes from each position on, as 0..1000 (1000: all different); exact, in integers.

    How often a byte occurs among its neighbours gives what it adds to the window on entering and takes on
    leaving; a running sum of both is the entropy, so no window is counted twice.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(1, WINDOW):
        same = (data[s:] == data[:-s]).view(np.uint8)
        before[s:] += same
        after[:-s] += same
    change = _GAIN[before].astype(np.int64)
    change[WINDOW:] -= _GAIN[after[: n - WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 :]
    return np.minimum(total * 1000 // (6 << 20), 1000).astype(np.int32)


def _inside(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether the length positions from each position on lie in one text."""
    ok = np.zeros(n + 1, np.int32)
    span = np.diff(offsets) - length + 1
    real = span > 0
    np.add.at(ok, offsets[:-1][real], 1)
    np.add.at(ok, offsets[:-1][real] + span[real], -1)
    return np.cumsum(ok[:-1]).astype(bool)


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected windows, by text and position, each hash once for a text.

    rank orders the entropies, the rarest lowest. A window is selected if it is the leftmost of lowest rank in at
    least POPULAR of the runs of WINDOW neighbouring windows that it stands in.
    """
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n < 2 * WINDOW - 1:
        return none
    level = entropies(data)
    m = len(level)
    bits = max(1, int(m).bit_length())
    key = (rank[level].astype(np.uint64) << np.uint64(bits)) | np.arange(m, dtype=np.uint64)
    if bits <= 20:
        key = key.astype(np.uint32)
    for s in (1, 2, 4, 8, 16, 32):
        key[:-s] = np.minimum(key[:-s], key[s:])
    whole = _inside(offsets, n, 2 * WINDOW - 1)[:m]
    at = (key[whole] & key.dtype.type((1 << bits) - 1)).astype(np.int64)
    if not len(at):
        return none
    # The leftmost lowest window only moves forward, so its runs are neighbours.
    turn = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    popular = np.diff(np.append(turn, len(at)))
    at = at[turn][popular >= POPULAR]
    at = at[level[at] >= LEAST_ENTROPY]
    h = simhash.run_hashes(data, at, np.full(len(at), WINDOW, np.int64))
    text = np.searchsorted(offsets, at, "right") - 1
    order = np.lexsort((np.arange(len(h)), h, text))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1]))) if len(h) else np.zeros(0, bool)
    keep = np.sort(order[fresh])
    return text[keep], h[keep]


def filters(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(filters of each text, the filters one after the other): PER_FILTER features go to a filter of BITS bits, then the next begins."""
    count = np.bincount(text, minlength=n)
    chain = -(-count // PER_FILTER)
    base = np.concatenate(([0], np.cumsum(chain)))
    nth = np.arange(len(h)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    where = base[text] + nth // PER_FILTER
    flags = np.zeros((int(base[-1]), BITS), bool)
    for k in range(HASHES):
        flags[where, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return chain, np.packbits(flags, axis=1)


def overlaps(a: pa.Array, b: pa.Array, block: int = 1 << 15) -> np.ndarray:
    """0..100 for each pair of digests: for each filter of the shorter one the best normalised overlap with a filter of the other, on average.

    An overlap counts from 30 % of the way between what chance gives and the most that is possible. A digest
    without a filter compares to nothing: 0. About block pairs of filters are held at a time.
    """
    (wide, x, nx), (wide_y, y, ny) = _rows(a), _rows(b)
    swap = nx > ny
    bits = np.concatenate((wide, wide_y))
    x, y = np.where(swap, y + len(wide), x), np.where(swap, x, y + len(wide))
    nx, ny = np.minimum(nx, ny), np.maximum(nx, ny)
    size = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    out = np.zeros(len(nx))
    pairs = np.flatnonzero(nx)
    total, start = np.cumsum(nx[pairs] * ny[pairs]), 0
    while start < len(pairs):
        stop = max(start + 1, int(np.searchsorted(total, block + (total[start - 1] if start else 0), "right")))
        p = pairs[start:stop]
        # Every filter of the shorter digest, and for each of them every one of the other.
        own = np.repeat(p, nx[p])
        first = np.cumsum(nx[p]) - nx[p]
        f = x[own] + np.arange(len(own)) - np.repeat(first, nx[p])
        many = ny[own]
        begin = np.cumsum(many) - many
        i = np.repeat(f, many)
        j = np.repeat(y[own] - begin, many) + np.arange(len(i))
        both = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
        chance, most = size[i] * size[j] / BITS, np.minimum(size[i], size[j])
        floor = chance + 0.3 * (most - chance)
        score = np.where((both > floor) & (most > floor), 100 * (both - floor) / np.maximum(most - floor, 1e-9), 0.0)
        out[p] = np.add.reduceat(np.maximum.reduceat(score, begin), first) / nx[p]
        start = stop
    return out


def _rows(digests: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All filters as rows of words of 64 bits, the first of each digest, and how many it has."""
    digests = digests.cast(pa.large_binary())
    offsets = np.frombuffer(digests.buffers()[1], np.int64)[digests.offset : digests.offset + len(digests) + 1]
    data = np.frombuffer(digests.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]) // (BITS // 8)
    return np.frombuffer(data.tobytes(), np.uint64).reshape(-1, BITS // 64), offsets[:-1], np.diff(offsets)


def overlap(a: bytes, b: bytes) -> float:
    """overlaps() of one pair."""
    return float(overlaps(pa.array([a], pa.binary()), pa.array([b], pa.binary()))[0])


def probes(h: np.ndarray, owner: np.ndarray, part: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which features are looked up: of every filter (owner, part) all but a fifth, and one more, the least of level first, then by hash.

    Two filters that share a fifth of the smaller one's features share at least one that is looked up for it.
    """
    order = np.lexsort((simhash.mix(h, 5), level, part, owner))
    o, p = owner[order], part[order]
    begin = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])))) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(h)))
    most = size - -(-size // 5) + 1
    out = np.zeros(len(h), bool)
    out[order] = np.arange(len(h)) - np.repeat(begin, size) < np.repeat(most, size)
    return out


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level by how seldom it occurs in the windows of all texts; ties: the lower level first."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in simhash.chunks(batch, "text"):
                data, offsets = raw(part.column(0))
                level = entropies(data)
                total += np.bincount(level[_inside(offsets, len(data), WINDOW)[: len(level)]], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in found:
        n[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(LEVELS)
    return rank


def digests(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """(doc_id, node, n_features, n_filters, digest, features) for every row; node is a hash of the text, digest is null without features."""
    rank = entropy_ranks(docs) if rank is None else rank

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text"):
                data, offsets = raw(part.column(2))
                n = part.num_rows
                text, h = features(data, offsets, rank)
                chain, bits = filters(text, h, n)
                count = np.bincount(text, minlength=n)
                value = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((np.concatenate(([0], np.cumsum(chain))) * (BITS // 8)).astype(np.int64)), pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                value = pc.if_else(pa.array(count > 0), value, pa.scalar(None, pa.binary()))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count.astype(np.int32)), pa.array(chain.astype(np.int32)), value, listed], ["doc_id", "node", "n_features", "n_filters", "digest", "features"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("node"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, node long, n_features int, n_filters int, digest binary, features array<long>")


def compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with the score of their digests in nodes (node, digest)."""
    one = nodes.select(F.col("node").alias("a"), F.col("digest").alias("da"))
    two = nodes.select(F.col("node").alias("b"), F.col("digest").alias("db"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "da", "db")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(overlaps(batch.column(2), batch.column(3)), 4))], ["a", "b", "score"])

    return both.mapInArrow(run, "a long, b long, score double")


def fingerprints(docs: DataFrame, least_score: float = 20.0) -> DataFrame:
    """(doc_id, n_features, n_filters, digest, group_id, score) for every row of docs (doc_id, text).

    The digest chains Bloom filters of the windows that are improbable in this corpus. Texts whose digests reach
    least_score are versions of each other, whatever their lengths: the overlap is normalised by the smaller digest,
    so an excerpt is a version of the text that contains it, and texts that share an excerpt which is a text of its own
    are connected through it. group_id is the least doc_id of the connected group, score the best score that the text
    reached (100 for equal texts, null if alone). Every feature is a key; a pair is a candidate if it shares one that is
    looked up for either text: of each filter all but a fifth, and one more, in an order of all features, common ones
    last by counters of a fixed size over all texts, and otherwise by hash. So texts of which two filters share a fifth
    of the smaller one's features always meet, however many near copies there are; a score counts from well above that.

    Edge cases: a null or empty text, or one under 127 bytes, has no features, a null digest and no partner except
    equal texts, which always share a group; ties go to the least id; repeated rows are each returned; an empty
    table gives an empty result; other columns are ignored.
    """
    base = cut(digests(docs), "digests")
    nodes = cut(base.where("n_features > 0").groupBy("node").agg(F.first("n_features").alias("n_features"), F.first("digest").alias("digest"), F.first("n_filters").alias("n_filters"), F.first("features").alias("features")), "digest-nodes")
    rows = cut(base.select("doc_id", "node"), "digest-rows")
    discard(base)

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = nodes.select("features").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    # The counters are COUNTERS at most, however many features there are; only those far above the mean come to the driver.
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    common = {r["at"]: int(math.log2(r["n"] / (mean + 8))) for r in counts.where(F.col("n") > 2 * (mean + 8)).collect()}
    level = np.zeros(COUNTERS, np.uint64)
    level[list(common)] = list(common.values())

    def first(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            lists = batch.column(1)
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = pc.list_value_length(lists).to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            probe = probes(h, owner, nth // PER_FILTER, level[(h >> np.uint64(44)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[owner]), pa.array(probe), pa.array(size[owner].astype(np.int32))], ["key", "node", "probe", "rank"])

    # A short text is the likeliest to lie in all the others, so each bucket is first held against its shortest.
    keys = nodes.select("node", "features").mapInArrow(first, "key long, node long, probe boolean, rank int")
    edges = cut(linked(keys, lambda pairs: compared(pairs, nodes).where(F.col("score") >= least_score)), "scored")
    best = edges.select(F.explode(F.array("a", "b")).alias("node"), "score").groupBy("node").agg(F.max("score").alias("best"))
    label = components(edges)
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    named = copies.join(label, "node", "left").join(best, "node", "left").withColumn("g", F.coalesce("label", "node"))
    group = named.groupBy("g").agg(F.min("least").alias("group_id"))
    per_node = named.join(group, "g").select("node", "group_id", F.when(F.col("copies") > 1, F.lit(100.0)).otherwise(F.col("best")).alias("score"))
    per_node = per_node.join(nodes.select("node", "n_features", "n_filters", "digest"), "node", "left").fillna(0, ["n_features", "n_filters"])
    return rows.join(per_node, "node").select("doc_id", "n_features", "n_filters", "digest", "group_id", "score")
