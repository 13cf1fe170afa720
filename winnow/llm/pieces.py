"""SentencePiece encoding and decoding of a BPE model by a relational lattice.

Texts are cut where no piece of the vocabulary can cross; each distinct segment is encoded once: its substrings of
bounded length are exploded and joined to the piece table, the edges of a segment are grouped by where they end, and
a fold over those positions keeps the best edge into each. A BPE model has no additive path score, so "best" is not
a sum: the edge into a position is the one that byte-pair merging would leave there. Two neighbouring pieces can
stand side by side only if no merge across their border would have come before one of the merges inside them. That
is decided from the edges that cross the border, which are part of the same lattice, so the fold stays a Viterbi
pass (one surviving edge per position, then a trace back) and gives exactly what the merges give.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import cut, discard

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NARROW = 1024
#: Rank of pieces that are merged last; ranks and times share a long, so both stay under 2^20.
LAST = 1_000_000
NEVER = (1 << 62) - 1
SEGMENTS_PER_TASK = 10_000
#: Characters of a segment up to which its positions are grouped inside the row.
SHORT = 100


@dataclass
class Vocabulary:
    """rank: of each normal piece, by how late it is merged; ids; trees: (left, right) of each piece that merging builds; byte_base: id of byte 0."""

    rank: dict[str, int]
    ids: dict[str, int]
    pieces: list[bytes]
    byte_base: int

    def merged(self, text: str) -> list[tuple]:
        """Merging done step by step: nodes (string, time, children)."""
        nodes = [(c, -1, None) for c in text]
        while True:
            best, at = None, -1
            for k in range(len(nodes) - 1):
                r = self.rank.get(nodes[k][0] + nodes[k + 1][0])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return nodes
            a, b = nodes[at], nodes[at + 1]
            nodes[at : at + 2] = [(a[0] + b[0], max(best, a[1], b[1]), (a, b))]

    def spine(self, node: tuple, side: int) -> list[tuple[int, int, int]]:
        """(length, time, time and rank at which it is used up) of the nodes along one side of a piece's tree, from the piece inward."""
        out, until = [], NEVER
        while True:
            out.append((len(node[0]), node[1], until))
            if node[2] is None:
                return out
            until = (node[1] << 20) | self.rank[node[0]]
            node = node[2][side]


@functools.lru_cache(maxsize=2)
def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rank, ids, pieces, base = {}, {}, [], 0
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(p[3:5], 16)
            base = i if value == 0 else base
            pieces.append(bytes([value]))
        elif sp.is_control(i):
            pieces.append(b"")
        elif sp.is_unknown(i):
            pieces.append(" ⁇ ".encode())
        else:
            if not sp.is_unused(i):
                rank[p], ids[p] = min(LAST, int(-sp.get_score(i))), i
            pieces.append(p.replace(SPACE, " ").encode())
    return Vocabulary(rank, ids, pieces, base)


def packed(spine: list[tuple[int, int, int]]) -> list[int]:
    """Each node of a spine in 64 bits: length - 1 (4), time + 1 (20), time (20) and rank (20) at which it is used up, as a signed long."""
    out = []
    for length, time, until in spine:
        x = ((length - 1) << 60) | ((time + 1) << 40) | min(until, (1 << 40) - 1)
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


@functools.lru_cache(maxsize=2)
def piece_rows(path: str = MODEL) -> list[tuple]:
    """(piece, id, rank, whole, left, right) of every normal piece; whole: merging its characters gives it; the spines are packed."""
    v = load(path)
    out = []
    for p, r in v.rank.items():
        nodes = v.merged(p)
        whole = len(nodes) == 1
        out.append((p, v.ids[p], r, whole, packed(v.spine(nodes[0], 0)) if whole else [], packed(v.spine(nodes[0], 1)) if whole else []))
    return out


@functools.lru_cache(maxsize=2)
def joints(path: str = MODEL) -> tuple[np.ndarray, np.ndarray]:
    """Which characters stand next to each other in some piece: a table for narrow ones, sorted codes for the others."""
    narrow, wide = np.zeros((NARROW, NARROW), bool), set()
    for p in load(path).rank:
        cp = [32 if c == SPACE else ord(c) for c in p]
        for a, b in zip(cp, cp[1:]):
            if a < NARROW and b < NARROW:
                narrow[a, b] = True
            else:
                wide.add((a << 21) | b)
    return narrow.reshape(-1), np.array(sorted(wide), np.int64)


def segments(texts: list[str], joint: tuple[np.ndarray, np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Start, end and hash of each segment, the first segment of each text with the count at the end, and the joined string.

    Every text that isn't empty gets a space in front; a segment ends where no piece has its last and next character.
    """
    whole = "".join(" " + t if t else "" for t in texts).replace(SPACE, " ")
    offsets = np.concatenate(([0], np.cumsum(np.array([len(t) + 1 if t else 0 for t in texts], np.int64))))
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    n = len(cp)
    narrow, wide = joint
    edge = np.ones(n + 1, bool)
    if n > 1:
        small = np.minimum(cp, NARROW - 1).astype(np.int32)
        held = narrow[small[:-1] * NARROW + small[1:]]
        odd = np.flatnonzero((cp[:-1] >= NARROW - 1) | (cp[1:] >= NARROW - 1))
        if len(odd):
            code = (cp[odd].astype(np.int64) << 21) | cp[odd + 1].astype(np.int64)
            at = np.minimum(np.searchsorted(wide, code), max(0, len(wide) - 1))
            held[odd] = (wide[at] == code) if len(wide) else False
            both = odd[(cp[odd] < NARROW) & (cp[odd + 1] < NARROW)]
            held[both] = narrow[cp[both].astype(np.int64) * NARROW + cp[both + 1]]
        edge[1:-1] = ~held
        edge[offsets] = True
    bound = np.flatnonzero(edge) if n else np.zeros(1, np.int64)
    start, end = bound[:-1], bound[1:]
    h = simhash.run_hashes(cp, start, end - start, seed)
    return start, end, h, np.searchsorted(start, offsets), whole


def distinct_segments(docs: DataFrame, path: str = MODEL, seed: int = 0) -> DataFrame:
    """(h, segment, other) of all texts, each h once; the space is written as the vocabulary writes it. other differs from segment if two have one hash."""
    joint = joints(path)

    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for part in simhash.chunks(batch, "text", 1 << 20):
                start, end, h, _, whole = segments([t or "" for t in part.column(0).to_pylist()], joint, seed)
                h, at = np.unique(h, return_index=True)
                place = np.searchsorted(seen, h)
                fresh = seen[np.minimum(place, len(seen) - 1)] != h if len(seen) else np.ones(len(h), bool)
                h, at, place = h[fresh], at[fresh], place[fresh]
                # What a task has sent is remembered up to a bound; beyond it a segment may be sent again, and is counted once all the same.
                seen = np.insert(seen, place, h) if len(seen) < 2_000_000 else h
                words = [whole[a:b].replace(" ", SPACE) for a, b in zip(start[at].tolist(), end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(words, pa.string())], ["h", "segment"])

    sent = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").mapInArrow(run, "h long, segment string")
    return sent.groupBy("h").agg(F.min("segment").alias("segment"), F.max("segment").alias("other"))


def encoded_segments(found: DataFrame, path: str = MODEL) -> DataFrame:
    """(h, ids) of segments (h, segment): the lattice, its grouping and the fold."""
    spark = found.sparkSession
    v = load(path)
    rows = piece_rows(path)
    longest = max(len(r[0]) for r in rows)
    if longest > 16:
        raise ValueError("pieces of more than 16 characters don't fit the packed spines")
    table = spark.createDataFrame(rows, "x string, id int, rank long, whole boolean, ls array<long>, rs array<long>")
    alone = f"array({packed([(1, -1, NEVER)])[0]}L)"

    def edges_of(some: DataFrame) -> DataFrame:
        """(h, edges): every piece at every place of a segment, in the order of their ends, the longest first."""
        # The edges of a segment stay in the partition that the segment is put in here, so the grouping shuffles nothing more.
        sub = (
            some.repartition(tasks, "h")
            .select("h", "segment", F.explode(F.sequence(F.lit(0), F.length("segment") - 1)).alias("s"))
            .select("h", "segment", "s", F.explode(F.expr(f"sequence(1, least({longest}, length(segment) - s))")).alias("l"))
            .select("h", "s", (F.col("s") + F.col("l")).alias("e"), F.expr("substring(segment, s + 1, l)").alias("x"))
        )
        # The piece table has the size of the vocabulary, whatever the input; a single character that it lacks is an edge of byte pieces.
        edges = sub.join(F.broadcast(table), "x", "left").where("id is not null or e = s + 1")
        edge = F.struct(
            "e",
            "s",
            F.coalesce("id", F.lit(-1)).alias("id"),
            F.expr("if(id is null, x, null)").alias("lacking"),
            F.expr("coalesce(rank, -1L)").alias("rank"),
            F.expr("coalesce(whole, true)").alias("whole"),
            F.expr(f"coalesce(ls, {alone})").alias("ls"),
            F.expr(f"coalesce(rs, {alone})").alias("rs"),
        )
        return edges.select("h", edge.alias("edge")).groupBy("h").agg(F.array_sort(F.collect_list("edge")).alias("edges"))

    tasks = max(1, -(-found.count() // SEGMENTS_PER_TASK))
    found = found.select("h", "segment")
    # The edges into each position, in the order of positions. Where a filter for every position would cost too much, positions are grouped relationally.
    byend = "transform(sequence(1, element_at(edges, -1).e), p -> struct(p as e, filter(edges, x -> x.e = p) as into))"
    short = edges_of(found.where(F.length("segment") <= SHORT)).select("h", F.expr(byend).alias("byend"))
    ends = edges_of(found.where(F.length("segment") > SHORT)).select("h", F.explode("edges").alias("x")).groupBy("h", F.col("x.e").alias("e")).agg(F.array_sort(F.collect_list("x")).alias("into"))
    lattice = short.unionByName(ends.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("e", "into"))).alias("byend")))
    # A merge c over the border x.s is early if both its halves stand on the spines there and it comes before either half is used up.
    part = lambda v, shift, bits: f"(shiftrightunsigned({v}, {shift}) & {(1 << bits) - 1}L)"
    when = f"shiftleft(greatest(c.rank, {part('a', 40, 20)} - 1, {part('b', 40, 20)} - 1), 20) + c.rank"
    early = f"""exists(slice(byend, x.s + 1, x.e - x.s), q -> exists(q.into, c -> c.s < x.s and c.rank >= 0 and
        exists(element_at(acc, x.s).rs, a -> {part('a', 60, 4)} = x.s - c.s - 1 and
        exists(x.ls, b -> {part('b', 60, 4)} = c.e - x.s - 1 and {when} < {part('a', 0, 40)} and {when} <= {part('b', 0, 40)}))))"""
    edge = "struct<e:int,s:int,id:int,lacking:string,rank:bigint,whole:boolean,ls:array<bigint>,rs:array<bigint>>"
    kept = f"""aggregate(byend, cast(array() as array<{edge}>),
        (acc, g) -> concat(acc, array(aggregate(g.into, cast(null as {edge}), (found, x) -> if(found is null and x.whole and (x.s = 0 or not {early}), x, found)))))"""
    as_bytes = f"transform(sequence(1, octet_length(x.lacking)), i -> cast(conv(substring(hex(encode(x.lacking, 'UTF-8')), 2 * i - 1, 2), 16, 10) as int) + {v.byte_base})"
    traced = f"""aggregate(reverse(kept), named_struct('at', size(kept), 'ids', cast(array() as array<int>)),
        (p, x) -> if(x.e = p.at, named_struct('at', x.s, 'ids', concat(if(x.id < 0, {as_bytes}, array(x.id)), p.ids)), p), p -> p.ids)"""
    return lattice.select("h", F.expr(kept).alias("kept")).select("h", F.expr(traced).alias("ids"))


class _Lookup:
    """The ids of segments by hash, as sorted arrays in the narrowest types that hold them."""

    def __init__(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray):
        order = np.argsort(h)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        ends = np.cumsum(size)
        # The ids are put in the order of the hashes, so that one array of bounds says where each segment's ids are.
        flat = flat[np.repeat(begin - (ends - size), size) + np.arange(len(flat))] if len(flat) else flat
        self.h = h[order]
        self.bound = np.concatenate(([0], ends)).astype(np.uint32 if len(flat) < 2**32 else np.int64)
        self.flat = flat.astype(np.uint16) if flat.max(initial=0) < 2**16 else flat

    @classmethod
    def of(cls, table) -> _Lookup:
        lists = table.column("ids").combine_chunks() if isinstance(table, pa.Table) else table.column("ids")
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        h = table.column("h").to_numpy() if isinstance(table, pa.Table) else table.column("h").to_numpy(zero_copy_only=False)
        return cls(h.view(np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))

    def encode(self, texts: list[str], joint, seed: int) -> pa.ListArray:
        _, _, h, first, _ = segments(texts, joint, seed)
        distinct, back = np.unique(h, return_inverse=True)
        at = np.searchsorted(self.h, distinct)[back] if len(h) else np.zeros(0, np.int64)
        start = self.bound[at].astype(np.int64)
        size = self.bound[at + 1].astype(np.int64) - start
        begin = np.cumsum(size) - size
        out = self.flat[np.repeat(start - begin, size) + np.arange(int(size.sum()))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(out)]))[first].astype(np.int32)), pa.array(out))


def encode(docs: DataFrame, path: str = MODEL, decoded: bool = False, broadcast_bytes: int = 192 << 20, block_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, ids, n_ids) for every row of docs (doc_id, text): the ids that the model's merging gives; and, if asked for, decoded, the text that the ids give.

    The distinct segments are encoded relationally (encoded_segments). If their ids take at most broadcast_bytes, they
    are sent to all tasks; otherwise texts are put in blocks of about block_bytes by hash, and each block is grouped
    with the ids of the segments that occur in it, so that no task needs the whole table.

    Edge cases: a null or empty text has no ids; characters that the vocabulary lacks become byte pieces; repeated
    rows are each returned; an empty table gives an empty result; other columns are ignored. A run of characters
    that can all be joined takes time quadratic in its length.
    """
    spark = docs.sparkSession
    joint = joints(path)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Two segments of one hash are seen here, and another seed keeps them apart.
    for seed in itertools.count():
        found = cut(distinct_segments(plain, path, seed), "segments")
        if not found.where("segment <> other").limit(1).count():
            break
        discard(found)
    table = cut(encoded_segments(found.drop("other"), path), "encoded")
    schema = "doc_id long, ids array<int>, n_ids int" + ", decoded string" * decoded
    names = ["doc_id", "ids", "n_ids"] + ["decoded"] * decoded
    decoder = _decoder(path) if decoded else None

    def rows(lookup, part):
        ids = lookup.encode([t or "" for t in part.column("text").to_pylist()], joint, seed)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pc.list_value_length(ids)] + ([decoder(ids)] if decoder else []), names)

    need = table.agg(F.coalesce(F.sum(16 + 4 * F.size("ids")), F.lit(0))).first()[0]
    if need <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(_Lookup.of(table.select("h", "ids").toArrow()))

        def run(batches):
            for batch in batches:
                for part in simhash.chunks(batch, "text", 1 << 20):
                    yield rows(shared.value, part)

        return plain.mapInArrow(run, schema)

    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocked = plain.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-total // block_bytes)))))

    def hashes(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text", 1 << 20):
                texts, block = [t or "" for t in part.column("text").to_pylist()], part.column("block").to_numpy()
                _, _, h, first, _ = segments(texts, joint, seed)
                owner = np.repeat(block, np.diff(first))
                pair = np.unique(np.stack([owner.astype(np.int64), h.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["block", "h"])

    wanted = blocked.select("block", "text").mapInArrow(hashes, "block long, h long").distinct().join(table, "h").select("block", "h", "ids")

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup = _Lookup.of(right)
        parts = [rows(lookup, part) for batch in left.select(["doc_id", "text"]).to_batches() for part in simhash.chunks(batch, "text", 1 << 20)]
        return pa.Table.from_batches(parts, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("decoded", pa.string())][: len(names)]))

    return blocked.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(together, schema)


def _decoder(path: str):
    """A function from id lists to texts."""
    pieces = load(path).pieces
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size

    def text_of(lists: pa.ListArray) -> pa.Array:
        lists = lists.cast(pa.list_(pa.int32()))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        width = size[ids]
        at = np.cumsum(width) - width
        data = flat[np.repeat(begin[ids] - at, width) + np.arange(int(width.sum()))]
        ends = np.concatenate((at, [len(data)]))[np.concatenate(([0], np.cumsum(n)))]
        front = (np.diff(ends) > 0) & (data[np.minimum(ends[:-1], max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(n), bool)
        keep = np.ones(len(data), bool)
        keep[ends[:-1][front]] = False
        offsets = ends - np.concatenate(([0], np.cumsum(front)))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.string())

    return text_of


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded, all columns, with decoded: the text of the ids (array of int), without the space in front.

    Byte pieces are joined to characters, and bytes that form none become U+FFFD. Edge cases: null or no ids give an
    empty text; control pieces have no text; an id outside the vocabulary is an error.
    """
    text_of = _decoder(path)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, text_of(part.column(at))], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
