"""Communities of largest modularity, by merging in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, materialize

MOST_ROUNDS = 200
#: How often the followers of a leader are halved before a single one is taken.
DRAWS = 6
#: Renamings put together in one plan, and bytes of links up to which Spark may broadcast what it joins to them.
STEPS, FEW = 6, 1 << 20


def modularity_communities(edges: DataFrame, resolution: float = 1.0, max_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, community): a greedy partition of the undirected graph; a community is named by its smallest node.

    Every node starts alone. In a round a hash makes half of the communities leaders. Each of the others picks the leader whose
    merging gains most modularity (ties: the smaller name), unless it would gain more beside a community that does not lead
    this time. Of those who picked a leader, all join whose gain stays positive even if everyone else had joined
    before; if nobody's does, the question is put to half of them, drawn by a hash, to a quarter and so on; and if nobody is left, the
    one with the largest gain joins. Merges of one round touch different leaders, so gains add up and modularity never sinks.
    Ends when no merging of two communities gains anything; raises after ``max_rounds``. The graph is contracted every round:
    what is left are communities with the weights between them, and a leader's crowd is only ever summed up, never gathered.

    Nodes are numbered in the order of their names, and a link is kept once, at the end with the smaller degree, with what
    a round asks of its ends beside it: a round moves the links three times, as numbers, and writes them once. Nodes are
    not carried along; the rounds' renamings are put together at the end.

    Self-loops and repeated edges count once or not at all (``undirected``); nodes without edges are in no community.
    """
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    pairs = materialize(e.distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("d"))
    names = materialize(ends.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name", "d"), "names")
    total = names.agg(F.sum("d")).first()[0]
    if not total:
        discard(pairs)
        return names.select(F.col("name").alias("node"), F.col("name").alias("community"))
    leads = lambda number: (F.pmod(F.xxhash64("name", F.lit(number)), F.lit(2)) == 0).alias("lead")
    price = lambda da, db: F.lit(float(resolution)) * da * db / F.lit(float(total))
    first = names.select(F.col("name").alias("old"), F.col("id").alias("new"), "d", leads(0))
    group, links, turns = names, materialize(_turned(pairs.withColumn("w", F.lit(1).cast("long")), first), "links"), []
    discard(pairs)
    for number in range(max_rounds):
        sides = [F.struct(F.col(x).alias("a"), F.col(f"d{x}").alias("da"), F.col(f"l{x}").alias("la"), F.col(y).alias("b"), F.col(f"d{y}").alias("db"), F.col(f"l{y}").alias("lb")) for x, y in ("ab", "ba")]
        seen = links.select("w", F.explode(F.array(*sides)).alias("_s")).select("w", "_s.*").withColumn("gain", F.col("w") - price(F.col("da"), F.col("db"))).where("gain > 1e-9")
        # of equal gains the smaller name: a larger gain is a smaller negative one
        pick = F.min(F.when(F.col("lb"), F.struct((-F.col("gain")).alias("loss"), "b", "w", "db")))
        looks = seen.where("NOT la").groupBy("a").agg(F.max("gain").alias("most"), pick.alias("x")).select("a", "most", "x.*")
        drawn = F.pmod(F.xxhash64("name", F.lit(number), F.lit("draw")), F.lit(1 << DRAWS)).alias("drawn")
        follow = looks.where(F.col("b").isNotNull() & (-F.col("loss") >= F.col("most") - 1e-9)).drop("most")
        follow = materialize(follow.join(group.select(F.col("id").alias("a"), F.col("d").alias("da"), drawn), "a"), "follow")
        if follow.isEmpty() and seen.isEmpty():
            discard(follow, links, *([group] if turns else []))
            return _members(names, turns)
        asked = lambda k: F.col("drawn") < (1 << (DRAWS - k))
        crowd = [F.coalesce(F.sum(F.when(asked(k), F.col("da"))), F.lit(0)).alias(f"crowd{k}") for k in range(DRAWS + 1)]
        tried = follow.join(follow.groupBy("b").agg(*crowd, F.min(F.struct("loss", "a")).alias("first")), "b")
        safe = lambda k: asked(k) & (F.col("w") - price(F.col("da"), F.col("db") + F.col(f"crowd{k}") - F.col("da")) > 1e-9)
        tried = tried.withColumns({f"safe{k}": safe(k) for k in range(DRAWS + 1)})
        asks = tried.groupBy("b").agg(*[F.max(f"safe{k}").alias(f"some{k}") for k in range(DRAWS + 1)])
        joins, before = F.lit(False), F.lit(False)
        for k in range(DRAWS + 1):
            joins = joins | (~before & F.col(f"some{k}") & F.col(f"safe{k}"))
            before = before | F.col(f"some{k}")
        joins = joins | (~before & (F.col("first.a") == F.col("a")))
        moves = materialize(tried.join(asks, "b").where(joins).select(F.col("a").alias("id"), F.col("b").alias("new")), "moves")
        named = group.join(moves, "id", "left").select(F.col("id").alias("old"), F.coalesce("new", "id").alias("new"), "d", "name")
        new_group = named.groupBy("new").agg(F.max(F.when(F.col("old") == F.col("new"), F.col("name"))).alias("name"), F.sum("d").alias("d"))
        new_group = materialize(new_group.withColumnRenamed("new", "id"), "group")
        turn = materialize(named.select("old", "new").join(new_group.select(F.col("id").alias("new"), "d", leads(number + 1)), "new"), "turn")
        near = new_group.select(F.col("id").alias("a"), F.col("d").alias("da"), leads(number + 1).alias("la"))
        # told apart where the end of smaller degree is: no task takes all links of a wide one
        met = _turned(links, turn).select("a", "b", "w", "db", "lb").repartition("a").groupBy("a", "b", "db", "lb").agg(F.sum("w").alias("w"))
        new_links = materialize(met.join(_merged(near, links), "a"), "links")
        discard(follow, moves, links, *([group] if turns else []))
        group, links = new_group, new_links
        turns.append(turn)
    raise RuntimeError(f"communities did not settle in {max_rounds} rounds")


def _turned(links: DataFrame, turn: DataFrame) -> DataFrame:
    """(a, b, w) with new ends by ``turn`` (old, new, d, lead) and, of both, degree and whether they lead; a is the end of smaller
    degree. Links within one community go. """
    end = lambda x: turn.select(F.col("old").alias(x), F.col("new").alias(f"_{x}"), F.col("d").alias(f"d{x}"), F.col("lead").alias(f"l{x}"))
    both = links.select("a", "b", "w").join(_merged(end("b"), links), "b").drop("b").join(_merged(end("a"), links), "a").where("_a <> _b")
    up = F.struct("da", "_a") < F.struct("db", "_b")
    pick = lambda x, y, name: F.when(up, F.col(x)).otherwise(F.col(y)).alias(name)
    return both.select(pick("_a", "_b", "a"), pick("_b", "_a", "b"), "w", *[pick(f"{c}a", f"{c}b", f"{c}a") for c in "dl"], *[pick(f"{c}b", f"{c}a", f"{c}b") for c in "dl"])


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` for a join with ``links``: by merging unless those are few, as nodes grow with the graph."""
    size = int(str(links._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return nodes if size <= FEW else nodes.hint("merge")


def _members(names: DataFrame, turns: list[DataFrame]) -> DataFrame:
    """(node, community) from the renamings of all rounds, put together from the last back to the first, each as large as the
    graph was then. A community is named by its smallest node."""
    found = None
    for number, turn in enumerate(reversed(turns)):
        step = turn.select("old", "new")
        found = step if found is None else step.join(found.select(F.col("old").alias("new"), F.col("new").alias("last")), "new").select("old", F.col("last").alias("new"))
        if number % STEPS == STEPS - 1:
            found = materialize(found, "members")
    if found is None:
        return names.select(F.col("name").alias("node"), F.col("name").alias("community"))
    found = materialize(found, "members")
    discard(*turns)
    # numbers are in the order of names
    least = found.groupBy("new").agg(F.min("old").alias("least"))
    one, other = names.select(F.col("id").alias("old"), F.col("name").alias("node")), names.select(F.col("id").alias("least"), F.col("name").alias("community"))
    return found.join(least, "new").join(other, "least").join(one, "old").select("node", "community")
