"""Clusters from similar pairs: average linkage in rounds of reciprocal nearest clusters, and first-come leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, materialize

MOST_ROUNDS = 500


def _pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, s) in both directions, once each with the largest similarity; null ends and pairs of one node are left out."""
    p = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b AND similarity IS NOT NULL").select("a", "b", F.col("similarity").cast("double").alias("s"))
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))


def average_linkage(nodes: DataFrame, pairs: DataFrame, threshold: float, max_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((node, cluster), (round, kept, gone, similarity, size)): clusters of ``nodes`` (column node) by average linkage over
    ``pairs`` (a, b, similarity), and the merges that made them. A pair that is not listed has similarity 0.

    The similarity of two clusters is the mean over all pairs between them. Each round joins all pairs of clusters that are
    each other's most similar one at ``threshold`` (over 0) or more. Average linkage never makes a merged cluster more similar to a
    third than its parts were, so these are the merges of a loop that joins the best pair of all each time; among equal
    similarities the smallest names go first. A cluster is named by its smallest node. The best pair of all always merges,
    so rounds end; raises after ``max_rounds``. Only sums between clusters are kept, and they shrink every round. Nodes
    that ``pairs`` does not list stay alone; repeated nodes count once, null ones not at all; pairs of nodes not in ``nodes``
    are left out."""
    if threshold <= 0:
        raise ValueError("clusters without a similar pair have similarity 0; the threshold must lie above it")
    member = materialize(nodes.where("node IS NOT NULL").select("node").distinct().select("node", F.col("node").alias("cluster")), "member")
    size = materialize(member.select(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("n")), "size")
    known = lambda end: member.select(F.col("node").alias(end))
    sums = materialize(_pairs(pairs).join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi"), "sums")
    merges = None
    for number in range(1, max_rounds + 1):
        mean = sums.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
        mean = mean.withColumn("mean", F.round(F.col("s") / (F.col("na") * F.col("nb")), 12)).where(F.col("mean") >= threshold)
        # of equally similar ones that whose pair of names is smallest, as both sides see it
        order = F.struct((-F.col("mean")).alias("far"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        best = materialize(mean.groupBy("a").agg(F.min(F.struct(order.alias("order"), "b", "na", "nb")).alias("x")).select("a", "x.b", "x.na", "x.nb", (-F.col("x.order.far")).alias("mean")), "best")
        if best.isEmpty():
            none = best.select(F.lit(0).alias("round"), F.col("a").alias("kept"), F.col("b").alias("gone"), F.col("mean").alias("similarity"), F.lit(0).cast("long").alias("size"))
            return member, none if merges is None else merges
        both = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi").where("a < b")
        done = materialize(both.select(F.lit(number).alias("round"), F.col("a").alias("kept"), F.col("b").alias("gone"), F.col("mean").alias("similarity"), (F.col("na") + F.col("nb")).alias("size")), "merges")
        merges = done if merges is None else merges.unionByName(done)
        moves = done.select(F.col("gone").alias("_old"), F.col("kept").alias("_new"))
        named = lambda df, c: df.join(moves, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", F.col(c))).drop("_old", "_new")  # noqa: B023, E731
        new = (
            materialize(named(member, "cluster"), "member"),
            materialize(named(size, "c").groupBy("c").agg(F.sum("n").alias("n")), "size"),
            materialize(named(named(sums, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("s").alias("s")), "sums"),
        )
        discard(best, member, size, sums)
        member, size, sums = new
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")


def first_come_clusters(nodes: DataFrame, pairs: DataFrame, threshold: float, max_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, leader): each node, in order, joins the first leader that is similar enough, else leads a cluster itself.

    A pass over all nodes in order, done in rounds: a node is settled once all similar nodes before it are: it joins the
    smallest of those that lead, or leads. The smallest unsettled node is always among them, so rounds end; raises after
    ``max_rounds`` (a chain of similar nodes in order needs a round for each). Nodes that no pair lists lead; repeated nodes count once,
    null ones not at all."""
    left = materialize(nodes.where("node IS NOT NULL").select("node").distinct(), "nodes")
    before = _pairs(pairs.where(F.col("similarity") >= threshold)).where("b < a").join(left.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), F.col("b").alias("other"))
    before = materialize(before.join(left, "node", "left_semi"), "before")
    settled = materialize(left.join(before, "node", "left_anti").select("node", F.col("node").alias("leader")), "settled")
    for _ in range(max_rounds):
        open_ = before.join(settled.select("node"), "node", "left_anti")
        seen = open_.join(settled.select(F.col("node").alias("other"), "leader"), "other", "left")
        state = seen.groupBy("node").agg(F.max(F.col("leader").isNull()).alias("waits"), F.min(F.when(F.col("leader") == F.col("other"), F.col("other"))).alias("leader"))
        new = materialize(state.where("NOT waits").select("node", F.coalesce("leader", "node").alias("leader")), "settled")
        if new.isEmpty():
            discard(new, before)
            return settled
        joined = materialize(settled.unionByName(new), "settled")
        discard(settled, new)
        settled = joined
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
