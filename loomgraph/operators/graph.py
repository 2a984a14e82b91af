"""Graph construction, validation and analytics on edge tables (source, target[, type, weight])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.runtime import discard, materialize

#: Other names under which records carry the ends of a relationship and an entity's name.
ALIASES = {"source": ("source", "source_id", "subject"), "target": ("target", "target_id", "object"), "name": ("name", "text"), "id": ("id", "entity_id")}


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename alias columns: the first alias with a value wins; the other aliases go."""
    for name, aliases in ALIASES.items():
        present = [a for a in aliases if a in df.columns]
        if present and present != [name]:
            df = df.withColumn(name, F.coalesce(*present)).drop(*[a for a in present if a != name])
    return df


def build_graph(entities: list[DataFrame], relationships: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of several sources as two tables; entities without an id take their name as id."""
    def union(parts: list[DataFrame]) -> DataFrame:
        out = canonical_names(parts[0])
        for part in parts[1:]:
            out = out.unionByName(canonical_names(part), allowMissingColumns=True)
        return out

    nodes = union(entities)
    if "name" in nodes.columns:
        nodes = nodes.withColumn("id", F.coalesce("id", "name"))
    return nodes, union(relationships)


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): both directions of every edge, once; self-loops go. Edges are told apart in one direction, then turned."""
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.*")


def issues(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, id): missing fields, duplicate ids, dangling ends, self-loops and isolated entities."""
    ids = entities.select(F.col("id").alias("_id")).distinct()
    parts = [
        entities.where("id IS NULL OR type IS NULL").select(F.lit("MISSING_FIELD").alias("issue"), F.coalesce("id", "name").alias("id")),
        entities.groupBy("id").count().where("count > 1").select(F.lit("DUPLICATE_ID").alias("issue"), "id"),
        edges.join(ids, F.col("source") == F.col("_id"), "left_anti").select(F.lit("DANGLING_EDGE").alias("issue"), F.col("source").alias("id")).distinct(),
        edges.join(ids, F.col("target") == F.col("_id"), "left_anti").select(F.lit("DANGLING_EDGE").alias("issue"), F.col("target").alias("id")).distinct(),
        edges.where("source = target").select(F.lit("SELF_LOOP").alias("issue"), F.col("source").alias("id")).distinct(),
        entities.select("id").join(undirected(edges).select(F.col("a").alias("id")), "id", "left_anti").select(F.lit("ISOLATED").alias("issue"), "id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


#: Rounds after which a loop that should have come to rest raises, rather than give out a part of its result.
MOST_ROUNDS = 10_000
#: Neighbours of a wide node that one task pairs with as many others.
HUB = 2_000


def in_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes that stay when nodes without an incoming or without an outgoing edge are taken away until there
    are none; empty exactly if the directed graph has no cycle."""
    e = materialize(edges.select("source", "target").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        left = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        left = materialize(left, "edges")
        before, after = e.count(), left.count()
        discard(e)
        e = left
        if before == after:
            break
    else:
        raise RuntimeError(f"cycles did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("source").alias("node")).distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): neighbours, and their share of all other nodes."""
    d = undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n), F.lit(True)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_depth: int, directed: bool = True) -> DataFrame:
    """(node, depth): the least number of edges from any seed (column node), up to ``max_depth``."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct() if directed else undirected(edges)
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = e.join(frontier, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(origin, node, distance, decay): outgoing neighbours within ``hops`` edges of each origin (column node of
    ``seeds``); decay is the largest product of weights among the shortest paths."""
    e = edges.groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.max("weight").alias("w"))
    frontier = seeds.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance"), F.lit(1.0).alias("decay")).distinct()
    seen = frontier = materialize(frontier, "hops")
    for hop in range(1, hops + 1):
        step = frontier.join(e, F.col("node") == F.col("a")).groupBy("origin", F.col("b").alias("node")).agg(F.max(F.col("decay") * F.col("w")).alias("decay"))
        frontier = materialize(step.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.lit(hop).alias("distance"), "decay"), "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def distance_band(hops: Column) -> Column:
    """direct up to 1 hop, near up to 3, mid-range up to 6, else distant."""
    return F.when(hops <= 1, "direct").when(hops <= 3, "near").when(hops <= 6, "mid-range").otherwise("distant")


def shortest_paths(edges: DataFrame, seeds: DataFrame, directed: bool = True) -> DataFrame:
    """(origin, node, cost, path): least total weight from each origin, by rounds of relaxation until none is cheaper;
    weights are not negative. Of equally cheap paths the one that is smallest as an array stays."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight")
    if not directed:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    e = e.groupBy("a", "b").agg(F.min("weight").alias("weight"))
    best = materialize(seeds.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("cost"), F.array(F.col("node")).alias("path")).distinct(), "paths")
    changed = best
    for _ in range(MOST_ROUNDS):
        step = changed.join(e, F.col("node") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select("origin", F.col("b").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("b")).alias("path"))
        new = best.unionByName(step).groupBy("origin", "node").agg(F.min(F.struct("cost", "path")).alias("x")).select("origin", "node", "x.*")
        new = materialize(new, "paths")
        changed = new.join(best.select("origin", "node", F.col("cost").alias("_c")), ["origin", "node"], "left").where("_c IS NULL OR cost < _c").drop("_c")
        best = new
        if changed.isEmpty():
            return best
    raise RuntimeError(f"paths did not settle in {MOST_ROUNDS} rounds")


def average_path_length(edges: DataFrame) -> DataFrame:
    """(pairs, mean_length): over the ordered pairs of different nodes that reach one another in the undirected graph."""
    sums = _path_sums(materialize(undirected(edges), "edges")).agg(F.coalesce(F.sum("reached"), F.lit(0)).alias("pairs"), F.sum("total").alias("total"))
    return sums.select("pairs", F.try_divide(F.col("total"), F.col("pairs")).alias("mean_length"))


def all_shortest_paths(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """(path, hops): all paths of the fewest edges, ties kept; none if there is no path. With ``max_hops`` a path of more
    edges is none. Levels from the source are found first, and paths are laid only along edges from level to level, back from the target."""
    e = materialize(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "edges")
    seed = e.sparkSession.createDataFrame([(source,)], "node string")
    seen = frontier = materialize(seed.withColumn("d", F.lit(0)), "levels")
    hops = 0
    while seen.where(F.col("node") == target).isEmpty() and not frontier.isEmpty() and (max_hops is None or hops < max_hops):
        hops += 1
        new = frontier.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(new.withColumn("d", F.lit(hops)), "levels")
        seen = seen.unionByName(frontier)
    paths = seen.where(F.col("node") == target).select(F.array("node").alias("path"), F.col("d").alias("hops"))
    for d in range(hops - 1, -1, -1):
        here = seen.where(F.col("d") == d).select("node")
        paths = paths.join(e, F.col("path")[0] == F.col("b")).join(here, F.col("a") == F.col("node")).select(F.concat(F.array("a"), F.col("path")).alias("path"), "hops")
    return paths


def k_shortest_paths(edges: DataFrame, source: str, target: str, k: int) -> DataFrame:
    """(path, cost): the k cheapest simple paths, by cost, then path; fewer if there are fewer. Weights are not negative.
    A partial path is dropped once k whole ones cost less."""
    e = materialize(edges.groupBy(F.col("source").alias("a"), F.col("target").alias("b")).agg(F.min("weight").alias("w")), "edges")
    frontier = e.sparkSession.createDataFrame([([source], 0.0)], "path array<string>, cost double")
    found = frontier.where("false")
    for _ in range(MOST_ROUNDS):
        last = F.element_at("path", -1)
        step = frontier.join(e, last == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"))
        step = materialize(step, "paths")
        if step.isEmpty():
            return found
        found = materialize(found.unionByName(step.where(F.element_at("path", -1) == target)).orderBy("cost", "path").limit(k), "paths")
        n, most = found.agg(F.count("*"), F.max("cost")).first()
        frontier = step.where(F.element_at("path", -1) != target)
        if n == k:
            frontier = frontier.where(F.col("cost") <= most)
    raise RuntimeError(f"paths did not settle in {MOST_ROUNDS} rounds")


def _levels(both: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(origin, node, d): distances from every origin (column node; all nodes if none are given), in rounds until no node
    is new."""
    nodes = both.select(F.col("a").alias("node")).distinct() if origins is None else origins.select("node").distinct()
    levels = frontier = materialize(nodes.select(F.col("node").alias("origin"), "node", F.lit(0).alias("d")), "levels")
    for depth in range(1, MOST_ROUNDS):
        new = frontier.join(both, F.col("node") == F.col("a")).select("origin", F.col("b").alias("node")).distinct().join(levels, ["origin", "node"], "left_anti")
        frontier = materialize(new.withColumn("d", F.lit(depth)), "levels")
        if frontier.isEmpty():
            return levels
        levels = levels.unionByName(frontier)
    raise RuntimeError(f"distances did not settle in {MOST_ROUNDS} rounds")


def _fold(both: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(levels, core, links): a graph (a, b) whose leaves are folded onto their neighbours in rounds until none is left.

    Each level holds what a round folded, (node, parent, n, s, q): ``n`` nodes hang together at the node, itself
    included, ``s`` is the sum of their distances to it, ``q`` that of the squared sizes of the branches that were folded onto it.
    ``core`` (node, n, s, q) is what stays, with ``links`` (a, b) among it: of a tree one node, else what lies on
    cycles and between them. Of two leaves linked to each other the larger one is folded."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    core = materialize(both.select(F.col("a").alias("node")).distinct().select("node", one.alias("n"), none.alias("s"), none.alias("q")), "core")
    links, levels = both, []
    for _ in range(MOST_ROUNDS):
        leaves = materialize(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg"), F.min("b").alias("parent")).where("deg = 1").select("node", "parent"), "leaves")
        end = leaves.select(F.col("node").alias("parent"), F.lit(True).alias("_leaf"))
        level = materialize(leaves.join(end, "parent", "left").where("_leaf IS NULL OR node > parent").select("node", "parent").join(core, "node"), "folded")
        discard(leaves)
        if level.isEmpty():
            return levels, core, links
        levels.append(level)
        gone = level.select("node")
        gain = level.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("_n"), F.sum(F.col("s") + F.col("n")).alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
        core = materialize(core.join(gone, "node", "left_anti").join(gain, "node", "left").select("node", *[(F.col(c) + F.coalesce(f"_{c}", none)).alias(c) for c in "nsq"]), "core")
        links = materialize(links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")
    raise RuntimeError(f"leaves did not settle in {MOST_ROUNDS} rounds")


def _unfold(levels: list[DataFrame], top: DataFrame, **carried: Column) -> DataFrame:
    """``top`` (node and the columns ``carried``) and what those columns become for every node folded onto it."""
    for level in reversed(levels):
        up = top.withColumnRenamed("node", "parent")
        top = top.unionByName(materialize(level.join(up, "parent").select("node", *[c.alias(name) for name, c in carried.items()]), "unfolded"))
    return top


def _path_sums(both: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(node, total, reached): the sum of the distances to all nodes reached from a node (of ``origins``, else from every
    one), and their number. Trees are folded, so pairs of nodes are made of the core alone."""
    levels, core, links = _fold(both)
    start = core
    if origins is not None:
        need = materialize(origins.select("node").distinct(), "need")
        for level in levels:
            need = materialize(need.unionByName(level.join(need, "node", "left_semi").select(F.col("parent").alias("node"))).distinct(), "need")
        levels, start = [level.join(need, "node", "left_semi") for level in levels], core.join(need, "node", "left_semi")
    sums = _levels(links, start).join(core, "node").groupBy(F.col("origin").alias("node")).agg(F.sum(F.col("d") * F.col("n") + F.col("s")).alias("total"), F.sum("n").alias("size"))
    # a step down to a branch of n nodes is a step nearer to these and one away from all others
    every = _unfold(levels, materialize(sums, "sums"), total=F.col("total") + F.col("size") - 2 * F.col("n"), size=F.col("size"))
    if origins is not None:
        every = every.join(origins.select("node").distinct(), "node", "left_semi")
    return every.select("node", "total", (F.col("size") - 1).alias("reached"))


def closeness(edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """(node, closeness): reachable / sum of distances, scaled by the share of nodes reachable. Trees cost no more than their
    edges, but of the core (nodes on and between cycles) it needs the distances from every node it is asked for: on
    a large graph with a large core give ``origins`` (column node), the nodes of interest."""
    both = materialize(undirected(edges), "edges")
    n = both.select("a").distinct().agg((F.count("*") - 1).alias("others"))
    sums = _path_sums(both, origins)
    return sums.join(F.broadcast(n), F.lit(True)).select("node", F.when(F.col("total") > 0, F.col("reached") / F.col("total") * F.col("reached") / F.col("others")).otherwise(0.0).alias("closeness"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-6, dangling: str = "drop") -> DataFrame:
    """(node, rank). ``dangling``: "drop" loses the rank of nodes without outgoing edges, "redistribute" shares it out
    evenly. Stops early when the change's length (L2) is under ``tolerance``; 0 runs all iterations."""
    e = materialize(edges.select("source", "target").where("source <> target").distinct(), "edges")
    nodes = materialize(e.select(F.explode(F.array("source", "target")).alias("node")).distinct(), "nodes")
    n = nodes.count()
    out = e.groupBy("source").agg(F.count("*").alias("degree"))
    links = materialize(e.join(out, "source"), "links")
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        flow = links.join(ranks, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("flow"))
        lost = 0.0
        if dangling == "redistribute":
            lost = (ranks.join(out, F.col("node") == F.col("source"), "left_anti").agg(F.sum("rank")).first()[0] or 0.0) / n
        new = materialize(nodes.join(flow, "node", "left").select("node", ((1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + lost)).alias("rank")), "ranks")
        if tolerance:
            change = new.join(ranks.withColumnRenamed("rank", "_r"), "node").agg(F.sqrt(F.sum(F.pow(F.col("rank") - F.col("_r"), 2)))).first()[0]
            ranks = new
            if change is not None and change < tolerance:
                break
        ranks = new
    return ranks


def eigenvector(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): power iteration over the undirected graph with a shift by one, scaled to a largest score of 1, until
    no score changes by more than ``tolerance``, else for ``iterations`` rounds. Scores are merge-joined: written ones are small
    files, and a broadcast in every round would pass them all through the driver."""
    both = materialize(undirected(edges), "edges")
    x = both.select(F.col("a").alias("node")).distinct().withColumn("score", F.lit(1.0))
    for _ in range(iterations):
        pulled = both.join(x.hint("merge"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.sum("score").alias("pull"))
        new = materialize(x.join(pulled.hint("merge"), "node").select("node", "score", (F.col("score") + F.col("pull")).alias("raw")), "scores")
        top = new.agg(F.max("raw")).first()[0]
        change = new.agg(F.max(F.abs(F.col("raw") / top - F.col("score")))).first()[0] if top else None
        x = new.select("node", (F.col("raw") / top).alias("score")) if top else new.select("node", "score")
        if change is None or change <= tolerance:
            break
    return x


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness): over all ordered pairs, the share of shortest paths that pass the node, halved (undirected).

    Trees are folded: at a node, all pairs in different branches pass it, whether these are folded or the rest of the graph.
    Pairs beyond, which only the core has, count by levels of path counts outwards and of dependencies back, for all
    origins in the core side by side; each of its nodes stands for all that are folded onto it."""
    tree, core, both = _fold(materialize(undirected(edges), "edges"))
    weight = core.select("node", "n")
    start = core.select(F.col("node").alias("origin"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths"), "n")
    levels = [materialize(start, "levels")]
    seen = levels[0].select("origin", "node", "n")
    for depth in range(1, MOST_ROUNDS):
        new = levels[-1].join(both, F.col("node") == F.col("a")).groupBy("origin", F.col("b").alias("node")).agg(F.sum("paths").alias("paths")).join(seen, ["origin", "node"], "left_anti")
        new = materialize(new.join(weight, "node").select("origin", "node", F.lit(depth).alias("d"), "paths", "n"), "levels")
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.unionByName(new.select("origin", "node", "n"))
    else:
        raise RuntimeError(f"distances did not settle in {MOST_ROUNDS} rounds")
    below = levels[-1].withColumn("delta", F.lit(0.0))
    total = below
    for level in reversed(levels[:-1]):
        child = below.select("origin", F.col("node").alias("b"), ((F.col("n") + F.col("delta")) / F.col("paths")).alias("share"))
        gain = child.join(both, "b").select("origin", F.col("a").alias("node"), "share").groupBy("origin", "node").agg(F.sum("share").alias("share"))
        below = materialize(level.join(gain, ["origin", "node"], "left").withColumn("delta", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share"), "delta")
        total = total.unionByName(below)
    beyond = total.where("d > 0").select("origin", F.col("node").alias("_at"), "delta").join(weight, F.col("origin") == F.col("node")).groupBy(F.col("_at").alias("node")).agg(F.sum(F.col("n") * F.col("delta")).alias("beyond"))
    size = _unfold(tree, materialize(seen.groupBy(F.col("origin").alias("node")).agg(F.sum("n").alias("size")), "sums"), size=F.col("size"))
    every = core.select("node", "n", "q")
    for level in tree:
        every = every.unionByName(level.select("node", "n", "q"))
    rest, others = F.col("size") - F.col("n"), F.col("size") - 1
    between = others * others - F.col("q") - rest * rest + F.coalesce("beyond", F.lit(0.0))
    return every.join(size, "node").join(beyond, "node", "left").select("node", (between / 2).alias("betweenness"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph; the component is its smallest node."""
    return connected_components(edges, "source", "target")


def label_propagation(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, community): all nodes at once take the most frequent label among their neighbours and, as one more vote,
    themselves; ties go to the smallest label. It ends when no label changes, else after ``rounds``: labels that swap for
    ever are a result too."""
    both = materialize(undirected(edges), "edges")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "community").unionByName(labels).groupBy("node", "community").agg(F.count("*").alias("n"))
        new = materialize(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("x")).select("node", F.col("x.community").alias("community")), "labels")
        changed = not new.join(labels.withColumnRenamed("community", "_old"), "node").where("community <> _old").isEmpty()
        labels = new
        if not changed:
            break
    return labels


def triangle_communities(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node, community): overlapping communities of triangles that share edges one with the next; a node may be in several,
    one in no triangle is in none. A community is named by its smallest node, and communities of one name differ in nodes.
    ``groups`` (node, group) holds more edges: all nodes of one group are linked, without a row for each pair.

    Twins are linked nodes with the same neighbours. All edges of three twins are in one community: triangles of two twins
    and a third node hold an edge of both twins. So the three smallest of each set of twins stand for all of them, and the
    others join their communities. Twins are told by two hashes of their neighbours or groups, so 1 in 2^128 is wrong."""
    plain = materialize(edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "edges")
    turned = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda c, seed: F.bit_xor(F.xxhash64(c, F.lit(seed)))
    twins = None
    if groups is not None:
        held = materialize(groups.where("node IS NOT NULL AND group IS NOT NULL").select("node", "group").distinct(), "groups")
        circle = held.groupBy("node").agg(F.struct(mark("group", 1), mark("group", 2), F.count("*")).alias("circle"))
        around = turned.groupBy(F.col("a").alias("node")).agg(F.struct(mark("b", 1), mark("b", 2), F.count("*")).alias("around"))
        twins = _named_twins(circle.join(around, "node", "left").select("node", F.struct("circle", "around").alias("key")))
        few = held.join(twins.where("_at > 3").select("node"), "node", "left_anti")
        linked = few.join(few.withColumnRenamed("node", "other"), "group").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
        plain = materialize(_without(plain, twins).unionByName(linked).distinct(), "edges")
        turned = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # of linked nodes: the same neighbours, themselves among them
    ends = turned.unionByName(plain.select(F.explode(F.array("a", "b")).alias("a")).distinct().withColumn("b", F.col("a")))
    closed = _named_twins(ends.groupBy(F.col("a").alias("node")).agg(F.struct(mark("b", 1), mark("b", 2), F.count("*")).alias("key")))
    one = materialize(_without(plain, closed), "edges")
    closing = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(one.select("a", F.col("b").alias("c")), ["a", "c"], "left_semi")
    name = lambda x, y: F.to_json(F.array(x, y))
    triangles = materialize(closing.select("a", "b", "c", name("a", "b").alias("ab"), name("b", "c").alias("bc"), name("a", "c").alias("ac")), "triangles")
    links = triangles.select(F.col("ab").alias("x"), F.explode(F.array("bc", "ac")).alias("y"))
    part = connected_components(links, "x", "y").select(F.col("node").alias("ab"), F.col("component").alias("_part"))
    members = triangles.join(part, "ab").select("_part", F.explode(F.array("a", "b", "c")).alias("node")).distinct()
    for same in (closed, twins):
        if same is not None:
            more = same.where("_at > 3").select(F.col("node").alias("_more"), F.col("first").alias("node"))
            members = members.unionByName(members.join(more, "node").select("_part", F.col("_more").alias("node")))
    return members.join(members.groupBy("_part").agg(F.min("node").alias("community")), "_part").select("node", "community")


def _named_twins(keyed: DataFrame) -> DataFrame:
    """(node, _at, first): the place of each node among those of its key, and the first of them."""
    first = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 3").select("key", "first")
    at = F.row_number().over(W.partitionBy("first").orderBy("node"))
    return materialize(keyed.join(first, "key").select("node", "first").withColumn("_at", at), "twins")


def _without(edges: DataFrame, twins: DataFrame) -> DataFrame:
    """The edges among nodes that stand for their twins."""
    gone = twins.where("_at > 3").select("node")
    return edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(modularity): of (node, community) on the undirected graph."""
    both = undirected(edges)
    m2 = both.agg(F.count("*").alias("m2"))
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg")).join(communities, "node")
    share = deg.groupBy("community").agg(F.sum("deg").alias("deg"))
    inside = both.join(communities.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    t = share.join(inside, "community", "left").join(F.broadcast(m2), F.lit(True))
    return t.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), 2)).alias("modularity"))


def community_metrics(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, intra, inter): nodes, and directed edges inside and out of each community."""
    at = lambda end: communities.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    both = undirected(edges).join(at("a"), "a").join(at("b"), "b")
    counts = both.groupBy(F.col("c_a").alias("community")).agg(F.sum((F.col("c_a") == F.col("c_b")).cast("long")).alias("intra"), F.sum((F.col("c_a") != F.col("c_b")).cast("long")).alias("inter"))
    return communities.groupBy("community").agg(F.count("*").alias("size")).join(counts, "community", "left").na.fill(0, ["intra", "inter"])


def bridges(edges: DataFrame) -> DataFrame:
    """(a, b): edges a < b whose removal splits a component.

    A spanning forest is grown by levels from the smallest node of every component. Each other edge gets a random label,
    the hash of its ends, which is XORed into both of them; the XOR over a subtree is then that of the labels of
    the edges that leave it, and the tree edge above it is a bridge if no edge leaves it, which is when the XOR is 0 (two
    independent hashes, so 1 in 2^128 is wrong). Two passes over the levels, whatever the number of bridges."""
    both = materialize(undirected(edges), "edges")
    roots = connected_components(both, "a", "b").select(F.col("component").alias("node")).distinct()
    frontier = materialize(roots.select("node", F.lit(0).alias("d"), F.lit(None).cast(both.schema["a"].dataType).alias("parent")), "levels")
    levels, seen = [frontier], frontier
    for depth in range(1, MOST_ROUNDS):
        new = frontier.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = materialize(new.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("d"), "parent"), "levels")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier)
    else:
        raise RuntimeError(f"levels did not settle in {MOST_ROUNDS} rounds")
    tree = seen.where("parent IS NOT NULL").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    other = both.where("a < b").join(tree, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").alias("x"), F.xxhash64("b", "a").alias("y"))
    marks = materialize(other.groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")), "marks")
    below, found = None, None
    for level in reversed(levels[1:]):
        own = level.select("node", "parent").join(marks, "node", "left").select("node", "parent", "x", "y")
        if below is not None:
            passed = below.select(F.col("parent").alias("node"), "x", "y")
            own = own.select("node", "x", "y").unionByName(passed.join(level, "node", "left_semi")).groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).join(level.select("node", "parent"), "node")
        below = materialize(own.select("node", "parent", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")), "marks")
        cut = below.where("x = 0 AND y = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
        found = cut if found is None else found.unionByName(cut)
    return found if found is not None else tree


def link_scores(edges: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar, resource_allocation, preferential): scores of pairs a < b that share a
    neighbour and are not linked. They are as many as the two-step paths of the graph: a node of degree d makes d squared
    of them, dealt out to several tasks."""
    both = materialize(undirected(edges), "edges")
    degree = materialize(both.groupBy("a").agg(F.count("*").alias("deg")), "degrees")
    # neighbours of a wide node are dealt out: each pair of parts meets in a task of its own
    parts = F.ceil(F.col("deg") / HUB).cast("int")
    middle = both.join(degree, "a").where("deg > 1").select(F.col("a").alias("z"), "b", "deg", F.pmod(F.xxhash64("b"), parts).cast("int").alias("own"), F.sequence(F.lit(0), parts - 1).alias("others"))
    left = middle.select("z", F.col("b").alias("x"), "deg", F.col("own").alias("i"), F.explode("others").alias("j"))
    right = middle.select("z", F.col("b").alias("y"), F.explode("others").alias("i"), F.col("own").alias("j"))
    pairs = left.join(right, ["z", "i", "j"]).where("x < y").groupBy("x", "y").agg(F.count("*").alias("common"), F.sum(1 / F.log("deg")).alias("adamic_adar"), F.sum(1 / F.col("deg")).alias("resource_allocation"))
    pairs = pairs.join(both.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
    d = lambda c: degree.select(F.col("a").alias(c), F.col("deg").alias(f"deg_{c}"))
    pairs = pairs.join(d("x"), "x").join(d("y"), "y")
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "common", (F.col("common") / (F.col("deg_x") + F.col("deg_y") - F.col("common"))).alias("jaccard"), "adamic_adar", "resource_allocation", (F.col("deg_x") * F.col("deg_y")).alias("preferential"))


def top_preferential(edges: DataFrame, k: int = 20) -> DataFrame:
    """(a, b, score): the k unlinked pairs a < b of the largest product of degrees, ties by a and b.

    The pairs among the highest degrees give a bound on the k-th score; then only degrees whose product reaches the bound
    are paired, class by class of equal degree. The first set grows until it holds k unlinked pairs."""
    both = materialize(undirected(edges), "edges")
    degree = materialize(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg")), "degrees")
    n, size, bound = degree.count(), 2 * k + 2, 0

    def unlinked(x: DataFrame, y: DataFrame, on) -> DataFrame:
        x, y = (df.select(F.col("node").alias(c), F.col("deg").alias(f"d{c}"), *[k for k in df.columns if k not in ("node", "deg")]) for df, c in ((x, "a"), (y, "b")))
        return x.join(y, on).where("a < b").join(both, ["a", "b"], "left_anti").select("a", "b", (F.col("da") * F.col("db")).alias("score"))

    while size < n:
        top = materialize(degree.orderBy(F.desc("deg"), "node").limit(size), "top").withColumn("_one", F.lit(1))
        best = unlinked(top, top, "_one").orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
        if best[0] == k:
            bound = best[1]
            break
        size *= 4
    classes = materialize(degree.groupBy("deg").count().select("deg"), "classes")
    one, two = classes.withColumnsRenamed({"deg": "d1"}), classes.withColumnsRenamed({"deg": "d2"})
    allowed = one.join(two, F.col("d1") * F.col("d2") >= bound)
    x = degree.join(allowed, F.col("deg") == F.col("d1")).select("node", "deg", F.col("d2").alias("_d"))
    return unlinked(x, degree.withColumn("_d", F.col("deg")), "_d").orderBy(F.desc("score"), "a", "b").limit(k)


def connectivity_metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean, largest and smallest degree, and a class of structure."""
    d = undirected(edges).groupBy("a").agg(F.count("*").alias("deg"))
    t = d.agg(F.count("*").alias("nodes"), (F.sum("deg") / 2).cast("long").alias("edges"), F.avg("deg").alias("mean_degree"), F.max("deg").alias("max_degree"), F.min("deg").alias("min_degree"))
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return t.withColumn("density", density).withColumn("structure", F.when(F.col("density") > 0.5, "dense").when(F.col("density") > 0.1, "moderate").otherwise("sparse"))


def random_walks(edges: DataFrame, length: int = 10, walks: int = 5, seed: int = 7) -> DataFrame:
    """(walk array<string>): walks from every node; the next node is drawn by a hash of walk, step and seed, so reruns
    agree. A step joins on the node and the place of the neighbour drawn: no node's neighbours are gathered."""
    both = undirected(edges)
    place = F.row_number().over(W.partitionBy("a").orderBy("b")) - 1
    nb = materialize(both.withColumn("place", place), "neighbours")
    degree = materialize(nb.groupBy("a").agg(F.count("*").alias("deg")), "degrees")
    state = degree.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w"), F.array("a").alias("walk"))
    for step in range(length - 1):
        pick = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "w", "walk"), F.col("deg")).cast("int")
        drawn = state.join(degree, F.col("node") == F.col("a")).select("w", "walk", F.col("a").alias("_at"), pick.alias("_place"))
        state = drawn.join(nb, (F.col("_at") == F.col("a")) & (F.col("_place") == F.col("place"))).select(F.col("b").alias("node"), "w", F.concat("walk", F.array("b")).alias("walk"))
        state = materialize(state, "walks")
    return state.select("walk")


def node_embeddings(edges: DataFrame, dim: int = 16, length: int = 10, walks: int = 5, seed: int = 7) -> DataFrame:
    """(node, vector): Word2Vec over random walks."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, minCount=0, windowSize=5, maxIter=1, seed=seed, inputCol="walk", outputCol="v").fit(random_walks(edges, length, walks, seed))
    return model.getVectors().withColumnsRenamed({"word": "node"})


def neighbour_rank(scores: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """Top ``k`` rows of each ``by``, ties by the remaining columns' order."""
    rest = [c for c in scores.columns if c not in (by, score)]
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), *rest))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
