"""Classes and properties inferred from a graph, seed data merged with extracted rows, and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import discard, materialize


def infer_classes(entities: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """(type, n): the types that enough entities have; a null type is none."""
    return entities.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= min_occurrences)


def infer_properties(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, domains, ranges, n): the sorted types at both ends of every kind of relationship; ends that no entity has
    add none. Edges are counted by their ends first, so a frequent kind shuffles a row for each pair of types only."""
    types = entities.select("id", F.col("type").alias("_type"))
    ends = (
        edges.join(types.withColumnsRenamed({"id": "source", "_type": "_from"}), "source", "left")
        .join(types.withColumnsRenamed({"id": "target", "_type": "_to"}), "target", "left")
        .groupBy("type", "_from", "_to").agg(F.count("*").alias("_n"))
    )
    return ends.groupBy("type").agg(F.sort_array(F.collect_set("_from")).alias("domains"), F.sort_array(F.collect_set("_to")).alias("ranges"), F.sum("_n").alias("n"))


def merge_seeds(seeds: DataFrame, extracted: DataFrame, key: str, strategy: str = "seed_first") -> DataFrame:
    """One row for every key of either side, both with the same columns and unique keys. ``seed_first`` and
    ``extracted_first`` take the whole row of that side where it has one, ``merge`` the seed's values where not null."""
    values = [c for c in seeds.columns if c != key]
    both = seeds.select(key, F.struct(*values).alias("_s")).join(extracted.select(key, F.struct(*values).alias("_e")), key, "full_outer")
    if strategy == "merge":
        return both.select(key, *[F.coalesce(f"_s.{c}", f"_e.{c}").alias(c) for c in values])
    first, second = ("_s", "_e") if strategy == "seed_first" else ("_e", "_s")
    return both.select(key, *[F.when(F.col(first).isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c) for c in values])


def lineage(links: DataFrame) -> DataFrame:
    """(id, ancestor, depth) over (id, parent) links: every ancestor at its smallest depth; cycles end. Each round
    joins only the pairs that the round before found."""
    links = materialize(links.where("id IS NOT NULL AND parent IS NOT NULL").select("id", "parent").distinct(), "links")
    steps = links.select(F.col("id").alias("ancestor"), F.col("parent").alias("_next"))
    known = fresh = materialize(links.where("id <> parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "lineage")
    depth = 1
    while not fresh.isEmpty():
        depth += 1
        found = fresh.join(steps, "ancestor").where("id <> _next").select("id", F.col("_next").alias("ancestor")).distinct()
        fresh = materialize(found.join(known, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        old, known = known, materialize(known.union(fresh), "lineage")
        if depth > 2:
            discard(old)
    return known


def shapes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(class, property, min_count, max_count, ranges): for each class of entities and kind of edge that leaves any of them
    the fewest and most edges of an entity, and the sorted classes at the other ends (a target that is no entity adds none).
    """
    typed = entities.where("type IS NOT NULL").select("id", F.col("type").alias("class"))
    sizes = typed.groupBy("class").agg(F.count("*").alias("_members"))
    out = edges.join(typed.withColumnRenamed("id", "source"), "source").join(typed.toDF("target", "_range"), "target", "left")
    ranges = out.groupBy("class", F.col("type").alias("property")).agg(F.array_sort(F.collect_set("_range")).alias("ranges"))
    each = out.groupBy("class", F.col("type").alias("property"), "source").agg(F.count("*").alias("n"))
    counts = each.groupBy("class", "property").agg(F.min("n").alias("_least"), F.max("n").alias("max_count"), F.count("*").alias("_with")).join(sizes, "class")
    least = F.when(F.col("_with") < F.col("_members"), 0).otherwise(F.col("_least"))
    return counts.join(ranges, ["class", "property"]).select("class", "property", least.alias("min_count"), "max_count", "ranges")


def shacl_lines(shapes: DataFrame) -> DataFrame:
    """(value): a SHACL property shape for each row of ``shapes``, in Turtle with the prefixes g: and sh:; names are percent-coded."""
    local = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    kinds = F.array_join(F.transform("ranges", lambda r: F.concat(F.lit("g:"), local(r))), " ")
    name = local(F.col("class"))
    text = F.concat(F.lit("g:"), name, F.lit("Shape a sh:NodeShape ; sh:targetClass g:"), name, F.lit(" ; sh:property [ sh:path g:"), local(F.col("property")), F.lit(" ; sh:minCount "), F.col("min_count").cast("string"), F.lit(" ; sh:maxCount "), F.col("max_count").cast("string"), F.lit(" ; sh:class ( "), kinds, F.lit(" ) ] ."))
    return shapes.select(text.alias("value"))


def shape_violations(entities: DataFrame, edges: DataFrame, shapes: DataFrame) -> DataFrame:
    """(id, property, issue): entities with fewer or more edges than the shape of their class allows (min_count, max_count),
    and those with an edge to a class that is not among its ranges (class)."""
    typed = entities.where("type IS NOT NULL").select("id", F.col("type").alias("class"))
    n = edges.groupBy(F.col("source").alias("id"), F.col("type").alias("property")).agg(F.count("*").alias("_n"))
    counted = typed.join(shapes, "class").join(n, ["id", "property"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wrong = F.when(F.col("_n") < F.col("min_count"), "min_count").when(F.col("_n") > F.col("max_count"), "max_count")
    number = counted.select("id", "property", wrong.alias("issue")).where("issue IS NOT NULL")
    ends = edges.select(F.col("source").alias("id"), F.col("type").alias("property"), "target").join(typed, "id").join(shapes.select("class", "property", "ranges"), ["class", "property"]).join(typed.toDF("target", "_range"), "target", "left")
    kind = ends.where(F.col("_range").isNull() | ~F.array_contains("ranges", F.col("_range"))).select("id", "property", F.lit("class").alias("issue")).distinct()
    return number.unionByName(kind)


def entity_uri(base: str) -> Column:
    """A stable address of an entity: its type, and the first 16 digits of the digest of its name in lower case without outer
    space. Null without a name."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.coalesce("type", F.lit("entity")), F.lit("/"), F.left(F.sha2(F.lower(F.trim("name")), 256), F.lit(16)))
