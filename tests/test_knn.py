"""Exact search by blocks against the scores of all pairs, on awkward vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as V

NAN, INF = float("nan"), float("inf")
ODD = [[1.0, None, 0.0], [NAN, 0.0, 1.0], [INF, 1.0, 1.0], [1.0, 2.0], [], None, [0.0, 0.0, 0.0], [1e200, 1.0, 1.0], [1e-200, 0.0, 0.0], [-0.0, 0.0, 1.0]]


def rows(seed: int, n: int):
    draw = random.Random(seed)
    some = [[float(draw.choice((-1, 0, 1, 2))), draw.gauss(0, 1), draw.gauss(0, 1)] for _ in range(n // 2)]
    return [(i, v) for i, v in enumerate((ODD + some + some)[:n])]


@pytest.mark.parametrize("metric", sorted(V.METRICS))
@pytest.mark.parametrize("block", [(16_384, 4_096, 1_024), (17, 5, 3)])
def test_blocks_find_what_all_pairs_give(spark, monkeypatch, metric, block):
    for name, value in zip(("ROW_BLOCK", "QUERY_BLOCK", "STRIP"), block, strict=True):
        monkeypatch.setattr(V, name, value)
    df = spark.createDataFrame(rows(3, 120), "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 3 = 0")
    pairs = df.where("embedding IS NOT NULL").alias("r").crossJoin(asked.where("embedding IS NOT NULL").alias("q"))
    scored = pairs.select(F.col("q.vec_id").alias("query_id"), F.col("r.vec_id").alias("vec_id"), V.METRICS[metric](F.col("r.embedding"), F.col("q.embedding")).alias("score"))
    want = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 7")
    got = V.knn(df, asked, 7, metric)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_a_search_scores_candidates_only(spark):
    """Pairs are not written out: what leaves the blocks is k rows for each query and block."""
    df = spark.createDataFrame(rows(5, 3_000), "vec_id long, embedding array<double>").where("vec_id >= 10")
    found = V.knn(df, df.where("vec_id % 10 = 0"), 2, "l2")
    assert found.count() == 299 * 2
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_empty_sides(spark):
    df = spark.createDataFrame(rows(5, 40), "vec_id long, embedding array<double>")
    assert V.knn(df, df.limit(0), 3).count() == 0
    assert V.knn(df.limit(0), df, 3).count() == 0
