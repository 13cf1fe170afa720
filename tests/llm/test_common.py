import random

import pytest
from pyspark.sql import functions as F

from winnow.llm import common


def brute(pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind,in_one_task", [("random", 0), ("path", 0), ("clique", 0), ("random", 10**6), ("star", 10**6), ("path", 10**6), ("empty", 10**6)])
def test_components_agree_with_union_find(spark, kind, in_one_task):
    r = random.Random(7)
    pairs = {
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)],
        "path": [(i, i + 1) for i in range(12)],
        "star": [(0, i) for i in range(1, 30)] + [(50, i) for i in range(20, 40)],
        "clique": [(i, j) for i in range(12) for j in range(i)],
        "empty": [],
    }[kind]
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), in_one_task).collect()
    want = {x: y for x, y in brute([p for p in pairs if p[0] != p[1]]).items()}
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.label for x in got} == want


def test_linked_tries_every_pair_of_a_bucket(spark):
    r = random.Random(3)
    rows = [(r.randrange(12), n) for n in range(120) for _ in range(2)]
    value = {n: r.randrange(40) for n in range(120)}
    near = lambda a, b: abs(value[a] - value[b]) <= 1
    table = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    verify = lambda pairs: pairs.where(F.abs(table[F.col("a")] - table[F.col("b")]) <= 1)
    edges = common.linked(spark.createDataFrame(rows, "key long, node long"), verify)
    got = {x.node: x.label for x in common.components(edges).collect()}
    buckets = {}
    for k, n in rows:
        buckets.setdefault(k, set()).add(n)
    pairs = [(a, b) for ns in buckets.values() for a in ns for b in ns if a < b and near(a, b)]
    assert got == brute(pairs)


def test_a_bucket_falls_together_by_its_node_of_least_rank(spark):
    """Of 60 nodes only the last, of least rank, is accepted with others: one round of pairs is enough."""
    tried = []

    def verify(pairs):
        tried.extend((p.a, p.b) for p in pairs.select("a", "b").collect())
        return pairs.where("b = 59")

    keys = spark.createDataFrame([(1, k, True, 1 if k == 59 else 20) for k in range(60)], "key long, node long, probe boolean, rank int")
    edges = {(e.a, e.b) for e in common.linked(keys, verify).collect()}
    assert edges == {(k, 59) for k in range(59)} and len(tried) == 59


def test_a_cluster_needs_the_shared_folder(spark):
    assert common.shared_folder(spark).startswith("file:")
