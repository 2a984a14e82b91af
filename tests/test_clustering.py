"""Average linkage and first-come clusters against plain loops."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import clustering as K

SCHEMA = "a string, b string, similarity double"


def case(seed: int, n: int = 24):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(n)]
    return nodes, {(a, b): r.random() for i, a in enumerate(nodes) for b in nodes[i + 1 :] if r.random() < 0.35}


def plain_linkage(nodes, pairs, threshold):
    clusters, merges = [[n] for n in nodes], []
    while True:
        best = None
        for i, x in enumerate(clusters):
            for y in clusters[i + 1 :]:
                mean = sum(pairs.get((min(a, b), max(a, b)), 0) for a in x for b in y) / (len(x) * len(y))
                if mean >= threshold and (best is None or mean > best[0]):
                    best = (mean, x, y)
        if best is None:
            return {n: c[0] for c in clusters for n in c}, sorted((kept, gone, round(m, 9)) for kept, gone, m in merges)
        mean, x, y = best
        merges.append((min(x[0], y[0]), max(x[0], y[0]), mean))
        clusters = sorted([c for c in clusters if c not in (x, y)] + [sorted(x + y)])


@pytest.mark.parametrize("seed", [1, 2])
def test_linkage_makes_the_merges_of_a_loop(spark, seed):
    nodes, pairs = case(seed)
    rows = [(b, a, s) if k % 2 else (a, b, s) for k, ((a, b), s) in enumerate(pairs.items())]
    frame = spark.createDataFrame([*rows, rows[0], (rows[0][0], rows[0][1], 0.0), (None, "n01", 1.0), ("n01", "n01", 1.0), ("n01", "other", 1.0)], SCHEMA)
    named = spark.createDataFrame([(n,) for n in [*nodes, nodes[0], None, "zz"]], "node string")
    member, merges = K.average_linkage(named, frame, 0.25)
    want, order = plain_linkage([*nodes, "zz"], pairs, 0.25)
    assert {r["node"]: r["cluster"] for r in member.collect()} == want
    assert sorted((r["kept"], r["gone"], round(r["similarity"], 9)) for r in merges.collect()) == order and len(order) > 8


def test_linkage_edges(spark):
    none, lone = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",), ("b",)], "node string")
    member, merges = K.average_linkage(lone, none, 0.5)
    assert sorted(map(tuple, member.collect())) == [("a", "a"), ("b", "b")] and merges.count() == 0
    tie = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9)], SCHEMA)
    found = K.average_linkage(spark.createDataFrame([(c,) for c in "abcd"], "node string"), tie, 0.6)[0]
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    with pytest.raises(ValueError):
        K.average_linkage(lone, none, 0.0)


def test_first_come_equals_one_pass(spark):
    nodes, pairs = case(3, 40)
    leaders, want = [], {}
    for n in nodes:
        first = next((x for x in leaders if pairs.get((min(x, n), max(x, n)), 0) >= 0.5), None)
        if first is None:
            leaders.append(n)
        want[n] = first or n
    frame = spark.createDataFrame([(b, a, s) for (a, b), s in pairs.items()] + [(None, "n01", 1.0), ("n00", "gone", 1.0)], SCHEMA)
    named = spark.createDataFrame([(n,) for n in [*nodes, None, nodes[3]]], "node string")
    assert {r["node"]: r["leader"] for r in K.first_come_clusters(named, frame, 0.5).collect()} == want
    assert K.first_come_clusters(named.limit(0), frame, 0.5).count() == 0
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(9)], SCHEMA)
    with pytest.raises(RuntimeError):
        K.first_come_clusters(named, chain, 0.5, max_rounds=3)
