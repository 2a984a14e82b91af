"""Queries of hierarchies: classes by name, labels of trees, concepts in triples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy as H
from loomgraph.plans.tables import SQL, places, table


def _classes(spark, d):
    """Part names, what their words say without spaces, their types, and a general class."""
    part = table(spark, d, "part")
    first = F.element_at(F.split("p_name", " "), 1)
    rows = part.select(F.explode(F.array("p_name", first, "p_type", F.concat_ws(" ", "p_name", "p_type"), F.regexp_replace("p_name", " ", ""))).alias("class"))
    return rows.unionByName(table(spark, d, "region").select(F.lit("Thing").alias("class")))


def class_hierarchy(spark, d):
    return H.class_parents(_classes(spark, d))


def _trees(spark, d):
    """Places below their regions, and the turns of conversations, each below the one before."""
    turn = lambda t: F.concat_ws(":", F.lit("t"), F.col("conv_id").cast("string"), t.cast("string"))
    turns = table(spark, d, "conversations").withColumn("_k", F.dense_rank().over(W.partitionBy("conv_id").orderBy("turn")))
    turns = turns.select(turn(F.col("_k")).alias("id"), F.when(F.col("_k") > 1, turn(F.col("_k") - 1)).alias("parent"))
    return places(spark, d).select(F.col("source").alias("id"), F.col("target").alias("parent")).unionByName(turns)


def tree_labels(spark, d):
    """The number of nodes below each, as the width of its range tells it."""
    return H.tree_labels(_trees(spark, d)).select("id", "root", "depth", ((F.col("high") - F.col("low") - 1) / 2).cast("long").alias("below"))


def nodes_below(spark, d):
    labels = H.tree_labels(_trees(spark, d))
    return H.below(labels, labels.select("id"))


def _triples(spark, d):
    """Regions, nations and kinds of parts as concepts of two schemes."""
    skos = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    iri = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string"))

    def rows(name, concept, scheme, label, *more):
        said = [skos(concept, H.RDF_TYPE, F.lit(H.SKOS + "Concept")), skos(concept, H.SKOS + "inScheme", F.lit(scheme)), skos(concept, H.SKOS + "prefLabel", label), *more]
        return table(spark, d, name).select(F.explode(F.array(*said)).alias("_t")).select("_t.*")

    part, nation, region = iri("part", "p_partkey"), iri("nation", "n_nationkey"), iri("region", "r_regionkey")
    of = iri("region", "n_regionkey")
    return (
        rows("region", region, "urn:places", F.col("r_name"))
        .unionByName(rows("nation", nation, "urn:places", F.col("n_name"), skos(nation, H.SKOS + "broader", of), skos(of, H.SKOS + "narrower", nation), skos(nation, H.SKOS + "altLabel", F.lower("n_name"))))
        .unionByName(rows("part", part, "urn:goods", F.col("p_name"), skos(part, H.SKOS + "altLabel", F.col("p_brand")), skos(part, H.SKOS + "altLabel", F.col("p_type"))))
    )


def skos_concepts(spark, d):
    return H.skos_concepts(_triples(spark, d)).withColumn("alt_labels", F.array_join("alt_labels", "|"))


def skos_search(spark, d):
    return H.search_concepts(_triples(spark, d), "RING", "urn:goods")


def skos_narrower(spark, d):
    triples = _triples(spark, d)
    labels = H.tree_labels(H.broader_links(triples))
    return H.below(labels, H.broader_links(triples).select(F.col("parent").alias("id")))


QUERIES = {f.__name__: f for f in (class_hierarchy, tree_labels, nodes_below, skos_concepts, skos_search, skos_narrower)}

_TREES = f"""{SQL},
tk AS (SELECT DISTINCT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
links AS (SELECT source AS id, target AS parent FROM places UNION SELECT 't:' || conv_id || ':' || k, CASE WHEN k > 1 THEN 't:' || conv_id || ':' || (k - 1) END FROM tk),
up AS (SELECT id, parent AS ancestor, 1::BIGINT AS distance FROM links WHERE parent IS NOT NULL UNION ALL SELECT up.id, l.parent, distance + 1 FROM up JOIN links l ON l.id = ancestor WHERE l.parent IS NOT NULL)"""
ORACLE_SQL = {
    "class_hierarchy": """WITH c AS (SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[1], p_type, p_name || ' ' || p_type, replace(p_name, ' ', '')]) AS class FROM part UNION SELECT 'Thing'),
p AS (SELECT class, unnest(generate_series(1, len(string_split(class, ' ')) - 1)) AS n FROM c),
q AS (SELECT p.class, c.class AS parent, n FROM p JOIN c ON c.class = array_to_string(string_split(p.class, ' ')[1:n], ''))
SELECT c.class, coalesce((SELECT arg_max(parent, n) FROM q WHERE q.class = c.class), CASE WHEN c.class <> 'Thing' THEN 'Thing' END) AS parent FROM c""",
    "tree_labels": f"""WITH RECURSIVE {_TREES}, n AS (SELECT id FROM links UNION SELECT parent FROM links WHERE parent IS NOT NULL),
d AS (SELECT id, max(distance) AS depth, arg_max(ancestor, distance) AS root FROM up GROUP BY id), b AS (SELECT ancestor, count(*) AS n FROM up GROUP BY ancestor)
SELECT n.id, coalesce(root, n.id) AS root, coalesce(depth, 0) AS depth, coalesce(b.n, 0) AS below FROM n LEFT JOIN d ON d.id = n.id LEFT JOIN b ON b.ancestor = n.id""",
    "nodes_below": f"WITH RECURSIVE {_TREES} SELECT ancestor, id, distance FROM up",
    "skos_concepts": """SELECT 'urn:region:' || r_regionkey AS concept, r_name AS pref_label, '' AS alt_labels FROM region
UNION ALL SELECT 'urn:nation:' || n_nationkey, n_name, lower(n_name) FROM nation
UNION ALL SELECT 'urn:part:' || p_partkey, p_name, array_to_string(list_sort(list_distinct([p_brand, p_type])), '|') FROM part""",
    "skos_search": """SELECT 'urn:part:' || p_partkey AS concept, CASE WHEN lower(p_name) LIKE '%ring%' THEN p_name WHEN lower(least(p_brand, p_type)) LIKE '%ring%' THEN least(p_brand, p_type) ELSE greatest(p_brand, p_type) END AS label
FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'""",
    "skos_narrower": "SELECT 'urn:region:' || n_regionkey AS ancestor, 'urn:nation:' || n_nationkey AS id, 1::BIGINT AS distance FROM nation",
}
