"""What the text operators share: tables in the cluster's folder, and connected groups."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="winnow-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own on a single machine.

    A cluster without the setting is an error, as a machine-local folder would not survive there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that later steps don't depend on lost executors.

    Parquet rather than checkpoint(): the files are compressed by column and give the planner the true size. Results are
    read later than this, so the table stays until the application ends, or until discard().
    """
    path = f"{shared_folder(df.sparkSession)}/winnow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(there)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._winnow_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that cut() wrote."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._winnow_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nodes_of(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): nodes has each node of rows (node, check, ...) once with the given columns of one of its rows.

    node and check are two hashes of the same content. Where contents of different check share a node, all but the
    one with the least check get a node of their own, so nodes are as distinct as 128 bits are. There are n^2 / 2^65 such
    nodes among n, so the list of them is small at any size.
    """
    one = lambda r: cut(r.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), *[F.first(c).alias(c) for c in columns]), "nodes")
    nodes = one(rows)
    clash = nodes.where("lo <> hi").select(F.col("node").alias("clashing"), "lo")
    if clash.limit(1).count():
        apart = rows.join(F.broadcast(clash), F.col("node") == F.col("clashing"), "left")
        rows = apart.withColumn("node", F.when(F.col("check") != F.col("lo"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("clashing", "lo")
        nodes = one(rows)
    return rows, nodes.drop("lo", "hi")


def prefix_for(df: DataFrame) -> str:
    """A beginning that no column of df has, for columns of our own beside them."""
    own = "__w"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def other_columns(df: DataFrame, *used: str) -> Column:
    """A hash of all columns but those used, which decides between rows that agree in those: the choice doesn't depend on their order."""
    fields = [f for f in df.schema.fields if f.name not in used]
    return F.xxhash64(F.lit(0), *[F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in fields])


def words_in(text: str | Column) -> Column:
    """White-space separated words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


#: Edges that one task joins into groups by itself: some 300 MB. More are joined by rounds of shuffles.
EDGES_IN_ONE_TASK = 4_000_000


def _in_one_task(batches):
    """(node, label) of the edges (a, b) of all batches: labels fall to the least neighbour, and to their label's label, until none changes."""
    parts = [np.stack([p.column(0).to_numpy(), p.column(1).to_numpy()]) for p in batches if p.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    for lo in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + 100_000]), pa.array(nodes[label[lo : lo + 100_000]])], ["node", "label"])


def components(edges: DataFrame, in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """(node, label) for every node of the edges (a, b), label being the least node of its connected group.

    Few edges go to one task. Beyond in_one_task of them, large-star and small-star steps alternate, whose number of
    rounds grows with the logarithm of the longest path; every round is a table in the shared folder. Both ways
    give the same labels. Loops and repeated edges don't matter.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    sum_now = total(now)
    if sum_now[0] <= in_one_task:
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, label long")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The least neighbour comes from a partial aggregate and a join, which Spark splits where a hub is large, and not from a window that one task fills.
        least = lambda df: df.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.where("b > a")
            .join(least(both), "a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = (
            large.join(least(large), "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = cut(small, "edges")
        sum_after = total(after)
        same = sum_now == sum_after
        discard(now)
        now, sum_now = after, sum_after
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def linked(keys: DataFrame, verify, sketch: int | None = None) -> DataFrame:
    """Edges (a, b) that join what verify accepts among nodes that share a key; enough of them for connected groups.

    keys has (key, node) and, if sketch is given, an integer s of which at most so many bits may differ between
    a pair worth verifying; if it has a boolean probe, only pairs are tried of which one at least is a probe for the key
    that they share. Every node is first held against one node of its bucket, the probe of least rank if keys has an integer rank, and of
    those the least, which is linear in the bucket; groups of copies fall together there. Pairs are then tried only between nodes that are still in
    different groups, so no pair is left out and a bucket full of one group's copies costs nothing more.
    verify takes pairs (a, b) and returns those accepted.
    """
    bucket = Window.partitionBy("key")
    if "s" not in keys.columns:
        keys = keys.withColumn("s", F.lit(0))
    if "probe" not in keys.columns:
        keys = keys.withColumn("probe", F.lit(True))
    if "rank" not in keys.columns:
        keys = keys.withColumn("rank", F.lit(0))
    close = (F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) <= sketch) if sketch is not None else F.lit(True)
    shared = cut(
        keys.select("key", "node", "s", "probe", "rank")
        .withColumn("first", F.min(F.struct(~F.col("probe"), "rank", "node", "s")).over(bucket))
        .withColumn("n", F.count("*").over(bucket))
        .withColumn("probed", F.max("probe").over(bucket))
        .where("n > 1 and probed")
        .drop("probed", "rank"),
        "buckets",
    )
    led = shared.select(F.col("first.node").alias("a"), F.col("node").alias("b"), "s", F.col("first.s").alias("t")).where("a <> b").where(close)
    edges = cut(verify(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "led")
    group = cut(components(edges), "groups")
    placed = shared.where("n > 2").select("key", "node", "s", "probe").join(group, "node", "left").select("key", "node", "s", "probe", F.coalesce("label", "node").alias("g"))
    # A bucket of one group only has nothing left to try.
    mixed = placed.withColumn("lo", F.min("g").over(bucket)).withColumn("hi", F.max("g").over(bucket)).where("lo <> hi").select("key", "node", "s", "probe", "g")
    left, right = mixed.toDF("key", "a", "s", "pa", "ga"), mixed.toDF("key", "b", "t", "pb", "gb")
    rest = left.join(right, (left.key == right.key) & (left.a < right.b) & (left.ga != right.gb) & (left.pa | right.pb)).where(close).select("a", "b").distinct()
    return edges.union(cut(verify(rest), "rest"))
