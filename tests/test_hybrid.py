"""Ranking and merging of what vectors, a graph and memory find."""

from __future__ import annotations

from loomgraph.operators import retrieval as V

SCHEMA = "query string, origin string, id string, content string, score double, related int, similarity double, rank int"


def test_scores_are_scaled_weighted_and_merged(spark):
    long = "x" * 100
    rows = [
        ("q", "vector", "1", "cat", 0.9, None, None, 7), ("q", "vector", "2", "dog", 0.1, None, None, 7), ("q", "vector", "3", long + "a", 0.5, None, None, 7),
        ("q", "memory", "9", "cat", 4.0, None, None, 7), ("q", "memory", "8", long + "b", 3.0, None, 1.0, 7), ("q", "memory", "7", None, 0.0, None, None, 7),
        ("q", "graph", "n", "node", 1.0, 50, None, 7), ("q", "graph", "n", "node again", 0.0, 3, None, 7), ("q", "graph", None, "no id", 0.5, None, 0.5, 7),
        ("r", "graph", "n", "alone", 0.4, None, None, 7), ("r", "other", "n", "left out", 9.0, None, None, 7), (None, "vector", "n", "nobody asked", None, None, None, 7),
    ]
    got = {}
    for r in V.rank_and_merge(spark.createDataFrame(rows, SCHEMA), 10).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["origin"], r["id"], round(r["score"], 6)))
    want = [
        (1, "graph", "n", round((0.5 + 0.2) * 1.2, 6)),  # found twice, related capped
        (2, "vector", "1", 0.5),  # the best of two with one content
        (3, "graph", None, round(0.7 * 0.25 + 0.3 * 0.5, 6)), (4, "vector", "3", 0.25), (5, "memory", "7", 0.0), (6, "vector", "2", 0.0),
    ]
    assert sorted(got["q"]) == want
    assert got["r"] == [(1, "graph", "n", 0.2)] and got[None] == [(1, "vector", "n", 0.0)]
    assert V.rank_and_merge(spark.createDataFrame(rows, SCHEMA), 2, least=0.4).where("query = 'q'").count() == 2
    assert V.rank_and_merge(spark.createDataFrame([], SCHEMA), 3).count() == 0
