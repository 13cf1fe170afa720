"""Matching of SimHash fingerprints in two levels: buckets that are shuffled, and tries over further bits inside each bucket, in memory."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import simhash

#: Rows of a bucket that one task holds: some 50 MB. More nodes make the buckets' keys longer.
ROWS_IN_BUCKET = 1_000_000
#: Rows of a bucket above which those of its largest group aren't compared with each other.
WIDE = 512


def _distance(fp: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs (i, j) are within limit bits; the second half is looked at only where the first allows it."""
    half = np.bitwise_count(fp[i, 0] ^ fp[j, 0])
    out = half <= limit
    at = np.flatnonzero(out)
    out[at] = half[at].astype(np.int16) + np.bitwise_count(fp[i[at], 1] ^ fp[j[at], 1]) <= limit
    return out


def merged(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pair for each two labels that the pairs (i, j) join, and the labels after joining: the least row of each group."""
    low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    _, at = np.unique(low.astype(np.int64) * len(label) + high, return_index=True)
    i, j = i[at], j[at]
    label = label.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    return i, j, label


def _later_pairs(size: np.ndarray, first: np.ndarray, block: int):
    """Blocks of pairs of positions (i, j), j before i in i's bucket, for every i that is the first[bucket]-th of its bucket or later.

    size: rows of each bucket, the buckets one after the other. About block pairs come at a time.
    """
    begin = np.cumsum(size) - size
    bucket = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(bucket)) - begin[bucket]
    rows = np.flatnonzero((nth >= first[bucket]) & (nth > 0))
    width = nth[rows]
    total, start = np.cumsum(width), 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(total, block + (total[start - 1] if start else 0), "right")))
        r, w = rows[start:stop], width[start:stop]
        i = np.repeat(r, w)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[bucket[r]], w)
        start = stop


def _largest_first(key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by key with the rows of each key's largest label first, the size of each key's bucket, and of that label in it."""
    _, at = np.unique(label, return_inverse=True)
    by_key = np.argsort(key, kind="stable")
    bucket = np.empty(len(key), np.int64)
    bucket[by_key] = np.cumsum(np.concatenate(([0], key[by_key][1:] != key[by_key][:-1])))
    order = np.argsort(bucket * (len(key) + 1) + at)
    k, g = key[order], label[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new_run = new_key | np.concatenate(([True], g[1:] != g[:-1]))
    run = np.flatnonzero(new_run)
    length = np.diff(np.append(run, len(k)))
    bucket_of_run = np.cumsum(new_key)[run] - 1
    top = np.lexsort((-length, bucket_of_run))
    head = top[np.concatenate(([True], bucket_of_run[top][1:] != bucket_of_run[top][:-1]))]
    is_head = np.zeros(len(run), bool)
    is_head[head] = True
    again = np.argsort(2 * np.cumsum(new_key) + ~np.repeat(is_head, length), kind="stable")
    return order[again], np.diff(np.append(np.flatnonzero(new_key), len(k))), length[head]


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each run of equal keys."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return begin, np.diff(np.append(begin, len(key)))


def bucket_edges(key: np.ndarray, fp: np.ndarray, limit: int, label: np.ndarray | None = None, size: np.ndarray | None = None, ratio: float = 0.0, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of equal key within limit bits, enough of them to join all such rows into groups, and the rows' labels after that.

    label: groups that are joined already (the least row of each). With size, only pairs matter whose smaller size is at least
    ratio times the larger. Rows that agree in the most further bits are verified first, which joins a group of
    copies in linear time however dense it is. The climb to the bucket itself then compares all rows at every
    distance, of buckets that still hold several groups; in those of more than WIDE rows it tries rows outside the bucket's
    largest group against the rows before them. No pair that could join two groups is left out.
    """
    n = len(key)
    label = np.arange(n) if label is None else label
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, label
    # Rows by key, then by further bits; their labels are positions in that order until the end.
    room = np.uint64(63 - int(key.max()).bit_length())
    order = np.argsort((key.astype(np.uint64) << room) | (fp[:, 0] >> (np.uint64(64) - room)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    least = np.full(n, n)
    np.minimum.at(least, label, place)
    key, fp, label = key[order], fp[order], least[label[order]]
    size = None if size is None else size[order]
    found = [(none, none)]
    for gap in (1, 2):
        i = np.flatnonzero(key[gap:] == key[:-gap]) if n > gap else none
        i = i[label[i] != label[i + gap]]
        i = i[_distance(fp, i, i + gap, limit)]
        i, j, label = merged(i, i + gap, label)
        found.append((i, j))
    begin, many = _buckets(key)
    mixed = np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)
    # Sizes narrow what a row is compared with, so buckets may be larger then.
    wide = (many > (WIDE if size is None else 16 * WIDE)) & mixed
    some = np.flatnonzero(mixed & ~wide)
    rows = np.repeat(begin[some] - (np.cumsum(many[some]) - many[some]), many[some]) + np.arange(int(many[some].sum()))
    bucket = np.repeat(np.arange(len(some)), many[some])
    if len(rows):
        if size is None:
            reach = many[some] - 1
        else:
            rows = rows[np.lexsort((size[rows], bucket))]
            s = size[rows].astype(np.float64)
            top = s.max() + 1
            # In a bucket ordered by size, a row's partners are the rows up to its size divided by ratio.
            last = np.searchsorted(bucket * 2 * top + s, bucket * 2 * top + np.minimum(s / max(ratio, 1e-9) + 1e-6, 1.5 * top), "right") - 1
            reach = np.maximum.reduceat(last - np.arange(len(rows)), np.cumsum(many[some]) - many[some])
        # Buckets with the longest reach first, so that those that a gap still concerns are a prefix.
        by = np.argsort(-reach, kind="stable")
        start = np.cumsum(many[some]) - many[some]
        n_of = many[some][by]
        rows = rows[np.repeat(start[by] - (np.cumsum(n_of) - n_of), n_of) + np.arange(len(rows))]
        reach, bucket = reach[by], np.repeat(np.arange(len(some)), n_of)
        ends = np.cumsum(n_of)
        f0, f1 = fp[rows, 0].copy(), fp[rows, 1].copy()
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for gap in range(1, int(reach[0]) + 1):
            m = int(ends[np.searchsorted(-reach, -gap, "right") - 1])
            half = np.bitwise_count(f0[: m - gap] ^ f0[gap:m])
            at = np.flatnonzero(half <= limit)
            at = at[bucket[at] == bucket[at + gap]]
            at = at[half[at].astype(np.int16) + np.bitwise_count(f1[at] ^ f1[at + gap]) <= limit]
            i, j = rows[at], rows[at + gap]
            fresh = label[i] != label[j]
            hits.append((i[fresh], j[fresh]))
            held += int(fresh.sum())
            if held > 20_000:
                i, j, label = merged(*(np.concatenate(x) for x in zip(*hits)), label)
                found.append((i, j))
                hits, held = [], 0
        if held:
            i, j, label = merged(*(np.concatenate(x) for x in zip(*hits)), label)
            found.append((i, j))
    if wide.any():
        rows = np.flatnonzero(np.repeat(wide, many))
        arranged, sizes, head = _largest_first(key[rows], label[rows])
        arranged = rows[arranged]
        for i, j in _later_pairs(sizes, head, block):
            i, j = arranged[i], arranged[j]
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
            if size is not None:
                ok = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j]) - 1e-6
                i, j = i[ok], j[ok]
            ok = _distance(fp, i, j, limit)
            if ok.any():
                i, j, label = merged(i[ok], j[ok], label)
                found.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*found))
    back = np.empty(n, np.int64)
    back[order] = order[label]
    least = np.full(n, n)
    np.minimum.at(least, back, np.arange(n))
    return order[i], order[j], least[back]


def cross_pairs(key: np.ndarray, label: np.ndarray, fp: np.ndarray, limit: int, size: np.ndarray | None = None, ratio: float = 0.0, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (i, j) of equal key and different label within limit bits (and, with size, of sizes within ratio); rows of a bucket's largest label are not paired with each other."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(key) > 1:
        arranged, many, head = _largest_first(key, label)
        for i, j in _later_pairs(many, head, block):
            i, j = arranged[i], arranged[j]
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
            if size is not None:
                ok = np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j]) - 1e-6
                i, j = i[ok], j[ok]
            ok = _distance(fp, i, j, limit)
            found.append((i[ok], j[ok]))
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def spanning(i: np.ndarray, j: np.ndarray, label: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those of a forest that joins the same labels, the closest first, so that other buckets with the same rows choose the same (Boruvka)."""
    bits = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)
    order = np.lexsort((fp[i, 0] ^ fp[j, 0], bits))
    i, j = i[order], j[order]
    names, at = np.unique(label[np.concatenate((i, j))], return_inverse=True)
    a, b = at.reshape(2, -1)
    group, keep = np.arange(len(names)), np.zeros(len(i), bool)
    live = np.flatnonzero(a != b)
    while len(live):
        best = np.full(len(names), len(i))
        for end in (a, b):
            np.minimum.at(best, group[end[live]], live)
        chosen = np.unique(best[best < len(i)])
        keep[chosen] = True
        group = merged(group[a[chosen]], group[b[chosen]], np.arange(len(names)))[2][group]
        live = live[group[a[live]] != group[b[live]]]
    return i[keep], j[keep]


def sized_pairs(order: np.ndarray, key: np.ndarray, fp: np.ndarray, size: np.ndarray, limit: int, ratio: float, label: np.ndarray, join: bool, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of equal key and different label, within limit bits and of sizes within ratio, and the labels.

    order: the rows to compare, by key and size, so that a row's partners are those right behind it. With join, labels fall together
    on the way, and no more pairs are returned than that takes; otherwise all of them are, and labels stay.
    """
    key, size = key[order], size[order]
    f0, f1 = fp[order, 0], fp[order, 1]
    most = np.floor(size / ratio + 1e-6).astype(size.dtype)
    none = np.zeros(0, np.int64)
    found, hits, held = [(none, none)], [], 0
    for start in range(0, len(key) - 1, block):
        i, gap = np.arange(start, min(start + block, len(key) - 1)), 1
        while len(i):
            j = i + gap
            # Behind the first row that is too large, or of another key, a row has no partner.
            on = (key[j] == key[i]) & (size[j] <= most[i])
            i, j = i[on], j[on]
            at = np.flatnonzero(np.bitwise_count(f0[i] ^ f0[j]) <= limit)
            if len(at):
                x, y = i[at], j[at]
                ok = np.bitwise_count(f0[x] ^ f0[y]).astype(np.int16) + np.bitwise_count(f1[x] ^ f1[y]) <= limit
                x, y = order[x[ok]], order[y[ok]]
                ok = label[x] != label[y]
                hits.append((x[ok], y[ok]))
                held += len(hits[-1][0])
            if join and held > 20_000:
                x, y, label = merged(*spanning(*(np.concatenate(v) for v in zip(*hits)), label, fp), label)
                found.append((x, y))
                hits, held = [], 0
            gap += 1
            i = i[i < len(key) - gap]
    if held:
        x, y = (np.concatenate(v) for v in zip(*hits))
        if join:
            x, y, label = merged(*spanning(x, y, label, fp), label)
        found.append((x, y))
    x, y = (np.concatenate(v) for v in zip(*found))
    return x, y, label


def sized_edges(key: np.ndarray, fp: np.ndarray, size: np.ndarray, limit: int, ratio: float, label: np.ndarray, join: bool, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As sized_pairs(), of rows that come in order of size; keys of more than crowd rows go to bucket_edges() or cross_pairs(), whose work is less where most rows are of one group."""
    # Numpy sorts 16 bits by counting.
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    many = _buckets(key[order])[1] if len(key) else np.zeros(0, np.int64)
    large = np.repeat(many > crowd, many)
    i, j, label = sized_pairs(order[~large], key, fp, size, limit, ratio, label, join)
    r = order[large]
    if len(r):
        _, k = np.unique(key[r], return_inverse=True)
        _, at = np.unique(label[r], return_inverse=True)
        if join:
            least = np.full(int(at.max()) + 1, len(r))
            np.minimum.at(least, at, np.arange(len(r)))
            x, y, _ = bucket_edges(k, fp[r], limit, least[at], size[r], ratio)
            x, y, label = merged(r[x], r[y], label)
        else:
            x, y = (r[v] for v in cross_pairs(k, label[r], fp[r], limit, size[r], ratio))
        i, j = np.concatenate((i, x)), np.concatenate((j, y))
    return i, j, label


class Forest:
    """Tries over nodes (node, f0, f1 and, with a ratio, size) that find the pairs within limit bits, each with chance target at least.

    Level one: every node goes to how_many buckets by depth bits each, which are shuffled. A bucket holds about
    ROWS_IN_BUCKET rows at most (least bits at least), so depth, and with it how_many, grows with the logarithm of the nodes above
    that only. Blocks: the bits of the buckets are consecutive blocks of one permutation, and k + 1 blocks
    can't all be hit by k differing bits; otherwise each bucket has a permutation of its own.
    Level two: within a bucket, tries over further permuted bits, as deep as that bucket's own crowd calls for (about
    occupancy rows share a prefix), and as many as it takes. A bucket with few rows is climbed to its root at once.
    """

    def __init__(self, nodes: DataFrame, limit: int, target: float, least: int, occupancy: int, blocks: bool = False, ratio: float = 0.0):
        self.nodes, self.limit, self.count, self.ratio, self.occupancy = nodes, limit, nodes.count(), ratio, occupancy
        # The tries inside a bucket aren't shuffled, so little is left for them to miss; both levels together reach the target.
        self.inner = 1 - (1 - target) / 10
        self.depth = max(least, math.ceil(math.log2(max(1, self.count) / ROWS_IN_BUCKET)))
        self.how_many = simhash.tries(self.depth, limit, target / self.inner)
        if blocks:
            # What one bucket misses another may find: 1 - (1 - chance of the block * inner) ** how_many is the target.
            self.inner = (1 - (1 - target) ** (1 / self.how_many)) / simhash.survives(self.depth, limit)
        rng = np.random.default_rng(5)
        self.places = []
        while len(self.places) < self.how_many:
            order = rng.permutation(simhash.BITS)
            self.places += [order[k : k + self.depth] for k in range(0, simhash.BITS - self.depth + 1 if blocks else 1, self.depth)]
        self.places = self.places[: self.how_many]
        self.columns = ["node", "f0", "f1"] + ["size"] * (ratio > 0)

    def _spread(self, nodes: DataFrame, count: int) -> DataFrame:
        """(part, rows): for each slice of nodes and each part of the keys, its rows as one binary value of columns (32 bits of key and of size, then the others).

        Some hundred thousand small rows travel as one value, which the JVM moves as it is. A part holds keys of one trie.
        """
        places, how_many, sized = self.places, self.how_many, self.ratio > 0
        each = max(1, min(1 << self.depth, -(-count // ROWS_IN_BUCKET * 4), -(-count // 50_000)))

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 20_000):
                    columns = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.slice(lo, 20_000).columns])
                    fp = np.ascontiguousarray(columns[1:3].T)
                    size, columns = (columns[3].astype(np.uint32), np.delete(columns, 3, axis=0)) if sized else (np.zeros(len(fp), np.uint32), columns)
                    for t in range(how_many):
                        key = simhash.bits_of(fp, places[t])
                        part = (simhash.mix(key) % np.uint64(each)).astype(np.int32)
                        order = np.argsort(part, kind="stable")
                        cut = np.searchsorted(part[order], np.arange(each + 1))
                        short, long = np.stack((key[order].astype(np.uint32), size[order])), columns[:, order]
                        full = np.flatnonzero(np.diff(cut))
                        values = [short[:, cut[k] : cut[k + 1]].tobytes() + long[:, cut[k] : cut[k + 1]].tobytes() for k in full]
                        yield pa.RecordBatch.from_arrays([pa.array((t * each + full).astype(np.int32)), pa.array(values, pa.binary())], ["part", "rows"])

        self.parts_of_a_trie = each
        return nodes.mapInArrow(run, "part int, rows binary").repartition(each * how_many, "part")

    def _matched(self, spread: DataFrame, labelled: bool) -> DataFrame:
        limit, ratio, occupancy, target, each, places = self.limit, self.ratio, self.occupancy, self.inner, self.parts_of_a_trie, self.places

        def pairs(trie, key, fp, size, label):
            key_of = np.argsort(key, kind="stable")
            begin, many = _buckets(key[key_of])
            depth = np.ceil(np.log2(np.maximum(many / occupancy, 1))).astype(np.int64)
            free = np.setdiff1d(np.arange(simhash.BITS), places[trie])
            for d in np.unique(depth):
                some = np.flatnonzero(depth == d)
                rows = key_of[np.repeat(begin[some] - (np.cumsum(many[some]) - many[some]), many[some]) + np.arange(int(many[some].sum()))]
                bucket = np.repeat(np.arange(len(some), dtype=np.uint64), many[some])
                f, s, group = fp[rows], None if size is None else size[rows], None
                if size is not None:
                    # By size over all buckets, so that sorting by key keeps the rows of each key in order of size.
                    by = np.argsort(s, kind="stable")
                    rows, bucket, f, s = rows[by], bucket[by], f[by], s[by]
                    group = label[rows] if labelled else np.arange(len(rows))
                rng = np.random.default_rng(100 + trie)
                for _ in range(simhash.tries(int(d), limit, target, len(free)) if d else 1):
                    k = (bucket << np.uint64(d)) | simhash.bits_of(f, rng.permutation(free)[:d])
                    if size is not None:
                        i, j, group = sized_edges(k, f, s, limit, ratio, group, not labelled, 8 * occupancy)
                    elif labelled:
                        i, j = cross_pairs(k, label[rows], f, limit, s, ratio)
                    else:
                        i, j, group = bucket_edges(k, f, limit, group, s, ratio)
                    if len(i):
                        yield rows[i], rows[j]

        def run(batches):
            parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                for part, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = np.frombuffer(rows.as_buffer(), np.uint8)
                    n = len(data) // (4 + 4 + 8 * (4 if labelled else 3))
                    parts.setdefault(part, []).append((data[: 8 * n].view(np.uint32).reshape(2, n), data[8 * n :].view(np.uint64).reshape(-1, n)))
            for part in sorted(parts):
                short, long = (np.concatenate(x, axis=1) for x in zip(*parts.pop(part)))
                node, f0, f1, *label = long
                size = short[1].astype(np.int64) if ratio else None
                node = node.view(np.int64)
                for i, j in pairs(part // each, short[0].astype(np.uint64), np.stack([f0, f1], axis=1), size, label[0] if labelled else None):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

        return spread.mapInArrow(run, "a long, b long")

    def edges(self) -> DataFrame:
        """Edges (a, b), a < b, within limit bits: enough of them to join all such nodes into groups."""
        return self._matched(self._spread(self.nodes.select(*self.columns), self.count), False).distinct()

    def pairs_between(self, labelled: DataFrame) -> DataFrame:
        """All pairs (a, b), a < b, within limit bits among labelled nodes (their columns and label) whose labels differ."""
        return self._matched(self._spread(labelled.select(*self.columns, "label"), labelled.count()), True).distinct()
