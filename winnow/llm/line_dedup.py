"""Line dedup: SimHash of normalised lines, a join on pigeonhole blocks, verified edit similarity, one occurrence of each connected group kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import edits, simhash
from .common import components, cut, nodes_of, other_columns, prefix_for
from .forest import Forest

_NO_ID = 2**63 - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, text_key, text): the id (null ids last) and a hash of the text name a row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit("\0null"))).alias("text_key"), F.col("text").cast("string").alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, text_key, line_no, node, check, f0, f1, size) of every line that holds a word; node and check are hashes of its normalised words, size counts their characters."""

    def run(batches):
        for batch in batches:
            for part in simhash.chunks(batch, "text"):
                data, offsets = simhash.buffers(part.column(2))
                newline = np.flatnonzero(data == 10)
                bounds = np.unique(np.concatenate((offsets, newline)))
                if len(bounds) < 2:
                    continue
                _, h, first = simhash.words(data, bounds)
                # The bound of a line that follows a line end stands on that line end, which is no part of a word.
                doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
                # A text that begins with a line end has an empty first line, which has no bound of its own.
                line_no = np.searchsorted(newline, bounds[:-1], "right") - np.searchsorted(newline, offsets[doc], "left")
                take = np.flatnonzero(np.diff(first) > 0)
                fp = simhash.fingerprints(h, first)
                columns = [simhash.sequence_hash(h, first), simhash.sequence_hash(h, first, 11), fp[:, 0], fp[:, 1]]
                doc = pa.array(doc[take])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(doc), part.column(1).take(doc), pa.array(line_no[take].astype(np.int32)), *[pa.array(c[take].view(np.int64)) for c in columns], pa.array(simhash.characters(data, bounds)[take])],
                    ["doc", "text_key", "line_no", "node", "check", "f0", "f1", "size"],
                )

    return _keyed(docs).mapInArrow(run, "doc long, text_key long, line_no int, node long, check long, f0 long, f1 long, size long")


def _normalised(batches):
    for batch in batches:
        for part in simhash.chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), simhash.normalised(*simhash.buffers(part.column(1)))], ["node", "line"])


def line_groups(docs: DataFrame, similarity: float = 0.9, limit: int = 19, target: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The table of lines (see _lines) and (node, label) of those nodes that stand in a group of several; parameters as in dedup_lines().

    Nodes within limit bits are first joined by as few pairs as it takes, and these verified. Where all of a
    group's pairs hold there is nothing more to find; the groups that fell apart are matched again, and every pair
    between their parts verified. So a crowd of copies costs no more than its size, and no candidate is left out.
    """
    lines, nodes = nodes_of(cut(_lines(docs), "lines"), ["f0", "f1", "size", "doc", "text_key", "line_no"])
    forest = Forest(nodes, limit, target, least=10, occupancy=256, blocks=True, ratio=similarity)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, line): the normalised line, fetched from one document that has it."""
        where = nodes.join(wanted, "node", "left_semi").select("node", "doc", "text_key", "line_no").groupBy("doc", "text_key").agg(F.collect_list(F.struct("line_no", "node")).alias("want"))
        found = _keyed(docs).join(where, ["doc", "text_key"]).withColumn("parts", F.split("text", "\n")).select("parts", F.explode("want").alias("w"))
        return found.select(F.col("w.node").alias("node"), F.element_at("parts", F.col("w.line_no") + 1).alias("text")).mapInArrow(_normalised, "node long, line string")

    close = cut(forest.edges(), "close")
    texts = cut(texts_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct()).dropDuplicates(["node"]), "close-lines")

    def alike(batches):
        for batch in edits.gathered(batches):
            for part in simhash.chunks(batch, "x", 1 << 24):
                x, y = part.column(2), part.column(3)
                longer = np.maximum(*(pc.utf8_length(t).to_numpy(zero_copy_only=False) for t in (x, y)))
                keep = edits.within(x, y, np.floor((1 - similarity) * longer + 1e-9))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")

    first = cut(verified(close), "verified")
    group = components(close).withColumnRenamed("label", "whole")
    part = components(first)
    placed = cut(group.join(part, "node", "left").select("node", "whole", F.coalesce("label", "node").alias("label")), "parts")
    split = placed.groupBy("whole").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("whole")
    again = cut(placed.join(split, "whole", "left_semi").join(nodes.select("node", "f0", "f1", "size"), "node").select("node", "f0", "f1", "size", "label"), "again")
    second = cut(verified(forest.pairs_between(again)), "verified")
    return lines, components(first.union(second))


def _drops(docs: DataFrame, **params) -> DataFrame:
    """(doc, text_key, gone): the numbers of the lines of each document that repeat an earlier occurrence."""
    lines, label = line_groups(docs, **params)
    placed = lines.select("doc", "text_key", "line_no", "node").join(label, "node", "left").select("doc", "text_key", "line_no", F.coalesce("label", "node").alias("g"))
    placed = cut(placed.distinct(), "occurrences")
    first = placed.groupBy("g").agg(F.min(F.struct("doc", "text_key", "line_no")).alias("m"), F.count("*").alias("n")).where("n > 1").select("g", "m")
    later = placed.join(first, "g").where((F.col("doc") != F.col("m.doc")) | (F.col("text_key") != F.col("m.text_key")) | (F.col("line_no") != F.col("m.line_no")))
    return cut(later.groupBy("doc", "text_key").agg(F.collect_list("line_no").alias("gone")), "drops")


def _cleaned(docs: DataFrame, own: str, **params) -> DataFrame:
    """docs, repeated rows once, with columns of our own that begin with own: _text (the text without repeated lines), _lines and _gone."""
    name = lambda c: F.col(own + c)
    gone = _drops(docs, **params).toDF(own + "d", own + "t", own + "list")
    keyed = docs.withColumn(own + "a", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(own + "b", F.xxhash64(F.coalesce("text", F.lit("\0null"))))
    joined = keyed.join(gone, (name("a") == name("d")) & (name("b") == name("t")), "left")
    same = Window.partitionBy(own + "a", own + "b").orderBy(other_columns(docs, "doc_id", "text"))
    once = joined.withColumn(own + "n", F.row_number().over(same)).where(name("n") == 1)
    parts = F.split(F.col("text").cast("string"), "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(name("list"), i)), "\n")
    return once.withColumn(own + "_text", F.when(name("list").isNull(), F.col("text")).otherwise(left)).withColumn(own + "_gone", F.coalesce(F.size(own + "list"), F.lit(0))).withColumn(own + "_lines", F.coalesce(F.size(parts), F.lit(0)))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every document of docs (doc_id, text), repeated lines removed.

    Lines, of any length, are compared in lower case, as their words (runs of letters and digits) with one space between. Lines
    with the same words are repeats. So are lines whose edit similarity, 1 - Levenshtein distance / length of the longer
    one in characters, is at least similarity and of whose 128 bits of SimHash at most limit differ. Candidates share one of
    the blocks of bits (12 of 10 bits up to a thousand million lines; beyond, more and longer ones): pairs that differ in
    fewer bits than there are blocks in a permutation always do, those at limit bits with chance target over both levels of the search. Groups are
    connected, and the occurrence with the least (doc_id, hash of the text, line number) stays (null ids last).

    Edge cases: a null or empty text stays as it is; lines that are blank or without a word are kept; a
    document of which nothing is left has an empty text here; rows repeated with id and text count once (the one whose
    other columns have the least hash stays); an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    own = prefix_for(docs)
    return _cleaned(docs, own, **params).select("doc_id", F.col(own + "_text").alias("text"), F.col(own + "_lines").alias("n_lines"), F.col(own + "_gone").alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, **params) -> DataFrame:
    """docs, all columns, with text (and n_chars, if there) changed by dedup_lines(); documents that lost all their text are dropped."""
    own = prefix_for(docs)
    gone, text = F.col(own + "_gone"), F.col(own + "_text")
    done = _cleaned(docs, own, **params).where((gone == 0) | (F.trim(text) != ""))
    values = {"text": text, "n_chars": F.when(gone == 0, F.col("n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return done.select(*[values[c].alias(c) if values.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
