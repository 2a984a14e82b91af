"""Paths through edges that hold for a time, and distances as they change."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.temporal import active_at
from loomgraph.runtime import materialize, pieces_of

MOST_ROUNDS = 1000
#: Labels of a round up to which they are sent to the edges, and origins that an edge is moved for at once.
FEW, TOGETHER = 500_000, 64
ALWAYS, NEVER = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def temporal_paths(edges: DataFrame, seeds: DataFrame, order: Literal["strict", "overlap", "loose"] = "strict", start=None, end=None, max_hops: int | None = None, with_path: bool = True) -> DataFrame:
    """(origin, node, hops, label, path; without path unless ``with_path``): from each seed (column node) the paths that no other one beats.

    Edges are (source, target, valid_from, valid_until); a null bound is open. With ``start`` or ``end`` (timestamp Columns) only
    edges that hold at some time between them count. What may follow an edge:

    - strict: an edge that starts no earlier. The label is the last edge's start, and an earlier one beats a later one;
    - overlap: an edge that starts no later than the last one ended. The label is the last edge's end; a later one beats an
      earlier one;
    - loose: any edge; fewest edges alone count, and the label is null.

    An edge with an open start may follow anything, and after it anything may. A path beats another to the same node with no more
    edges and a label as good. Rounds go one edge further with all labels that the round before improved, so dominated
    ones are never extended; of equal ones the smallest path stays. Ends when no label improves, after ``max_hops``
    rounds, or raises.

    An edge leads all origins that may follow it to one label, so it is moved once for up to ``TOGETHER`` of them, and meets
    the labels known so far where these are grouped. Few labels are sent to the edges; many meet only if edges begin there."""
    first, last = F.lit(ALWAYS).cast("timestamp_ntz"), F.lit(NEVER).cast("timestamp_ntz")
    e = edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("valid_from").cast("timestamp_ntz").alias("s"), F.col("valid_until").cast("timestamp_ntz").alias("e"))
    if start is not None:
        e = e.where(F.col("e").isNull() | (F.col("e") >= start))
    if end is not None:
        e = e.where(F.col("s").isNull() | (F.col("s") <= end))
    # one number that is better when smaller: the start, or the negated end, in microseconds; an edge may follow a label up to its
    # begin, the start, or the negated one
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    sign, free = (1, micros(first)) if order != "overlap" else (-1, -micros(last))
    begin = F.lit(None).cast("long") if order == "loose" else sign * micros(F.col("s"))
    # copies of an edge lead to the same labels, so they need not be told apart
    e = materialize(e.select("a", "b", begin.alias("begin"), *([(-micros(F.col("e"))).alias("until")] if order == "overlap" else [])), "edges")
    rank = F.coalesce("until" if order == "overlap" else "begin", free)
    path = ["path"] if with_path else []
    labels = seeds.where("node IS NOT NULL").select(F.col("node").alias("origin"), "node").distinct().select("origin", "node", free.alias("rank"), *([F.array("node").alias("path")] if with_path else []))
    labels = materialize(labels.withColumn("fresh", F.lit(True)), "labels")
    pieces, parts, heads, seen = pieces_of(e), max(1, -(-labels.count() // TOGETHER)), None, []
    for hops in range(1, (max_hops or MOST_ROUNDS) + 1):
        frontier = labels.where("fresh")
        n = frontier.count()
        if n > FEW:
            heads = materialize(e.select(F.col("a").alias("node")).distinct(), "heads") if heads is None else heads
            frontier = materialize(frontier.join(heads, "node", "left_semi"), "frontier")
            n = frontier.count()
        if n == 0:
            break
        wide = n > FEW
        held = (frontier.repartition(pieces, "node") if wide else frontier).groupBy("node", F.pmod(F.xxhash64("origin"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("origin", "rank", *path)).alias("held"))
        held = held.hint("merge") if wide else F.broadcast(held)
        may = lambda x: F.col("begin").isNull() | (F.col("begin") >= x["rank"])
        led = F.transform(F.filter("held", may), lambda x: F.struct(x["origin"].alias("origin"), *([F.concat(x["path"], F.array("b")).alias("path")] if with_path else [])))
        step = (e.repartition(pieces, "a") if wide else e).join(held, F.col("a") == F.col("node")).select(F.col("b").alias("node"), rank.alias("rank"), led.alias("led"), F.lit(False).alias("known")).where(F.size("led") > 0)
        known = labels.select("node", "rank", F.array(F.struct("origin", *path)).alias("led"), F.lit(True).alias("known"))
        both = step.unionByName(known).repartition(pieces, "node").select("node", "rank", "known", F.inline("led"))
        # a number is grouped by hash, a struct by sorting all steps
        best = F.min(F.struct("rank", *path)) if with_path else F.struct(F.min("rank").alias("rank"))
        both = both.groupBy("origin", "node").agg(best.alias("x"), F.min(F.when(F.col("known"), F.col("rank"))).alias("was"))
        labels = materialize(both.select("origin", "node", "x.*", F.expr("was IS NULL OR x.rank < was").alias("fresh")), "labels")
        seen.append(labels.where("fresh").select("origin", "node", F.lit(hops).alias("hops"), "rank", *path))
    else:
        if max_hops is None:
            raise RuntimeError(f"temporal paths did not settle in {MOST_ROUNDS} rounds")
    time = F.timestamp_micros(sign * F.col("rank")).cast("timestamp_ntz")
    label = F.when((F.lit(order) != "loose") & (F.col("rank") != free), time)
    found = seen[0] if seen else labels.where("false").select("origin", "node", F.lit(0).alias("hops"), "rank", *path)
    for some in seen[1:]:
        found = found.unionByName(some)
    return found.select("origin", "node", "hops", label.alias("label"), *path)


def distance_history(edges: DataFrame, times: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """(at, hops, event): the fewest edges between two nodes, either way, among the edges that hold at each of ``times`` (column
    at), null where there is no path, and what changed since the time before: appeared, vanished, closer, farther or
    same; null at the first time. With ``max_hops`` a path of more edges is none.

    One frontier of (time, node) serves all times. Null times are left out, repeated ones count once."""
    at = materialize(times.where("at IS NOT NULL").select(F.col("at").cast("timestamp_ntz").alias("at")).distinct(), "times")
    e = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target", "valid_from", "valid_until")
    both = e.select(F.col("source").alias("a"), F.col("target").alias("b"), "valid_from", "valid_until").unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"), "valid_from", "valid_until"))
    both = materialize(both.where("a <> b").distinct(), "edges")
    seen = frontier = materialize(at.select("at", F.lit(source).alias("node"), F.lit(0).alias("hops")), "reached")
    for hops in range(1, (max_hops or MOST_ROUNDS) + 1):
        found = seen.where(F.col("node") == target).select("at")
        step = frontier.join(found, "at", "left_anti").join(both, F.col("node") == F.col("a")).where(active_at("valid_from", "valid_until", F.col("at")))
        new = step.select("at", F.col("b").alias("node")).distinct().join(seen.select("at", "node"), ["at", "node"], "left_anti")
        frontier = materialize(new.withColumn("hops", F.lit(hops)), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    else:
        if max_hops is None:
            raise RuntimeError(f"distances did not settle in {MOST_ROUNDS} rounds")
    hops = at.join(seen.where(F.col("node") == target).select("at", "hops"), "at", "left")
    # the times of a question are few, the graph is not: one ordered pass over them
    order = W.partitionBy(F.lit(0)).orderBy("at")
    before, first = F.lag("hops").over(order), F.row_number().over(order) == 1
    change = F.when(first, None).when(before.isNull() & F.col("hops").isNotNull(), "appeared").when(before.isNotNull() & F.col("hops").isNull(), "vanished").when(F.col("hops") < before, "closer").when(F.col("hops") > before, "farther").otherwise("same")
    return hops.select("at", "hops", change.alias("event"))
