"""Class and concept hierarchies: parents by name, interval labels of trees, and concepts read from triples.

A tree walked around its edges enters and leaves every node once. Numbered by that walk, the nodes below one are those
entered between its own two numbers, so "all below" and "all above" are range joins, however deep the tree is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.runtime import discard, materialize

#: The most general classes, in the order in which they are tried as a parent.
GENERAL = ("Entity", "Thing", "Resource")
#: Groups into which the children of one node are cut, so that no task orders all children of a wide node.
GROUPS = 4096
#: Numbers of a walk that share a bin of a range join.
BIN = 1024
SKOS = "http://www.w3.org/2004/02/skos/core#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def class_parents(classes: DataFrame) -> DataFrame:
    """(class, parent) for each distinct name in ``class``: the class named by the most leading words of it, written
    without spaces; else the first of GENERAL that is a class; else null. A general class taken that way is not its own
    parent. Null names are no classes."""
    names = classes.where("class IS NOT NULL").select("class").distinct()
    parts = F.filter(F.split("class", r"\s+"), lambda w: w != "")
    leads = names.withColumn("_w", parts).where(F.size("_w") > 1)
    leads = leads.select("class", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda n: F.array_join(F.slice("_w", F.lit(1), n), ""))).alias("_n", "parent"))
    named = leads.join(names.withColumnRenamed("class", "parent"), "parent").where("parent <> class")
    named = named.groupBy("class").agg(F.max_by("parent", "_n").alias("parent"))
    # at most one row, of one of three fixed names
    general = names.where(F.col("class").isin(*GENERAL)).agg(F.min_by("class", F.array_position(F.array(*map(F.lit, GENERAL)), F.col("class"))).alias("_general"))
    found = names.join(named, "class", "left").join(F.broadcast(general))
    return found.select("class", F.coalesce("parent", F.when(F.col("_general") != F.col("class"), F.col("_general"))).alias("parent"))


def _walk(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(at, next, weight): each entering and leaving of a node with the step that comes after it (null after a root is left)."""
    step = lambda c, enters: F.struct(F.col(c).alias("id"), F.lit(enters).alias("enters"))
    child = links.withColumn("_g", F.pmod(F.xxhash64("id"), F.lit(GROUPS)))
    inner = W.partitionBy("parent", "_g")
    groups = child.groupBy("parent", "_g").agg(F.min("id").alias("_first")).withColumn("_then", F.lead("_first").over(W.partitionBy("parent").orderBy("_g")))
    sibling = child.withColumn("_next", F.lead("id").over(inner.orderBy("id"))).join(groups, ["parent", "_g"])
    sibling = sibling.select("id", "parent", F.coalesce("_next", "_then").alias("_next"))
    first = groups.groupBy("parent").agg(F.min_by("_first", "_g").alias("_child")).withColumnRenamed("parent", "id")
    entered = nodes.join(first, "id", "left").select(step("id", True).alias("at"), F.when(F.col("_child").isNotNull(), step("_child", True)).otherwise(step("id", False)).alias("next"), F.lit(1).alias("weight"))
    left = nodes.join(sibling, "id", "left").select(step("id", False).alias("at"), F.when(F.col("_next").isNotNull(), step("_next", True)).when(F.col("parent").isNotNull(), step("parent", False)).alias("next"), F.lit(-1).alias("weight"))
    return entered.unionByName(left)


def tree_labels(links: DataFrame) -> DataFrame:
    """(id, root, depth, low, high): the numbers at which the walk of a tree enters and leaves each node, counted from 1
    in each tree, and how far the node is from its root. x is below y if both have one root and y.low < x.low < y.high.

    ``links`` are (id, parent). Repeated links are one; a null parent, or the node itself, adds the node alone; a null
    id adds nothing. A node with two parents, or on or below a cycle, is in no tree: both raise ValueError (``lineage`` serves those
    graphs). Every step of the walk learns the way to the end from the step that it points to, twice as far in each
    round, so n nodes take log2(2 n) rounds of one join, chains included; the children of a node are ordered in
    GROUPS parts."""
    given = materialize(links.where("id IS NOT NULL").select("id", "parent").distinct(), "tree-links")
    real = given.where("parent IS NOT NULL AND parent <> id")
    twice = real.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['id']} has {twice['n']} parents")
    nodes = given.select(F.explode(F.array("id", "parent")).alias("id")).where("id IS NOT NULL").distinct()
    # steps counts the steps from this one up to the end, fall the sum of their weights, last is the step that ends it
    now = materialize(_walk(real, nodes).select("at", "next", F.lit(1).cast("long").alias("steps"), F.col("weight").cast("long").alias("fall"), F.col("at").alias("last")), "walk")
    count = now.count()
    for _ in range(math.ceil(math.log2(max(count, 2))) + 1):
        if now.where("next IS NOT NULL").isEmpty():
            break
        far = now.select(F.col("at").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("fall").alias("_fall"), F.col("last").alias("_last"))
        moved = now.where("next IS NOT NULL").join(far, "next").select("at", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("fall") + F.col("_fall")).alias("fall"), F.col("_last").alias("last"))
        old, now = now, materialize(now.where("next IS NULL").unionByName(moved), "walk")
        discard(old)
    else:
        lost = now.where("next IS NOT NULL").first()
        if lost is not None:
            raise ValueError(f"{lost['at']['id']} is on or below a cycle")
    pair = now.groupBy("at.id").agg(
        F.max(F.when(F.col("at.enters"), F.col("steps"))).alias("_in"), F.max(F.when(~F.col("at.enters"), F.col("steps"))).alias("_out"),
        (-F.max(F.when(F.col("at.enters"), F.col("fall")))).alias("depth"), F.first("last.id").alias("root"),
    )
    total = pair.where("id = root").select("root", F.col("_in").alias("_all"))
    numbered = pair.join(total, "root")
    return numbered.select("id", "root", "depth", (F.col("_all") - F.col("_in") + 1).alias("low"), (F.col("_all") - F.col("_out") + 1).alias("high"))


def below(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ancestor, id, distance): all nodes below each distinct node of ``seeds`` (id), by the numbers of ``tree_labels``.
    Seeds that no tree holds have none. Ranges meet nodes in bins of BIN numbers: an ancestor is sent to the bins of its
    own range only."""
    tops = labels.join(seeds.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("ancestor"), "root", F.col("depth").alias("_depth"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    tops = tops.where("_high > _low + 1").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / BIN), F.floor(F.col("_high") / BIN))))
    nodes = labels.withColumn("_bin", F.floor(F.col("low") / BIN))
    found = tops.join(nodes, ["root", "_bin"]).where("low > _low AND low < _high")
    return found.select("ancestor", "id", (F.col("depth") - F.col("_depth")).alias("distance"))


def skos_concepts(triples: DataFrame, scheme: str | None = None) -> DataFrame:
    """(concept, pref_label, alt_labels) of every subject typed skos:Concept in ``triples`` (subject, predicate, object),
    of one scheme or all. Of several preferred labels the smallest counts, none is an empty text; other labels are distinct and
    sorted. Rows with a null add nothing."""
    rows = triples.where("subject IS NOT NULL AND object IS NOT NULL")
    known = rows.where((F.col("predicate") == RDF_TYPE) & (F.col("object") == SKOS + "Concept")).select("subject").distinct()
    if scheme is not None:
        known = known.join(rows.where((F.col("predicate") == SKOS + "inScheme") & (F.col("object") == scheme)), "subject", "left_semi")
    labels = rows.where(F.col("predicate").isin(SKOS + "prefLabel", SKOS + "altLabel")).select("subject", "predicate", "object").distinct()
    found = labels.groupBy("subject").agg(
        F.min(F.when(F.col("predicate") == SKOS + "prefLabel", F.col("object"))).alias("p"),
        F.sort_array(F.collect_set(F.when(F.col("predicate") == SKOS + "altLabel", F.col("object")))).alias("a"),
    )
    return known.join(found, "subject", "left").select(F.col("subject").alias("concept"), F.coalesce("p", F.lit("")).alias("pref_label"), F.coalesce("a", F.array().cast("array<string>")).alias("alt_labels"))


def search_concepts(triples: DataFrame, word: str, scheme: str | None = None) -> DataFrame:
    """(concept, label): concepts with a label that holds ``word``, in any case; of several the preferred one, then the
    smallest."""
    known = skos_concepts(triples, scheme)
    every = F.concat(F.array("pref_label"), F.col("alt_labels"))
    label = F.get(F.filter(every, lambda t: F.contains(F.lower(t), F.lit(word.lower()))), F.lit(0))
    return known.select("concept", label.alias("label")).where("label IS NOT NULL")


def broader_links(triples: DataFrame) -> DataFrame:
    """(id, parent): what skos:broader says of concepts, and skos:narrower turned round, each link once."""
    up = triples.where(F.col("predicate") == SKOS + "broader").select(F.col("subject").alias("id"), F.col("object").alias("parent"))
    down = triples.where(F.col("predicate") == SKOS + "narrower").select(F.col("object").alias("id"), F.col("subject").alias("parent"))
    return up.unionByName(down).where("id IS NOT NULL AND parent IS NOT NULL").distinct()
