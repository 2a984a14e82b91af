"""Queries of shapes, ontology changes, evolution metrics, triangle communities and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import graph as G
from loomgraph.operators import ontology as O
from loomgraph.operators import retrieval as V
from loomgraph.operators import temporal as T
from loomgraph.plans.tables import SQL, entities, places, relationships, table


def _moved(spark, d):
    """Places in which every tenth customer has a second nation and every ninth supplier none."""
    e = places(spark, d).select("source", "target", "type")
    key = F.try_element_at(F.split("source", ":"), F.lit(2)).cast("int")
    twice = e.where(F.col("source").startswith("c:") & (key % 10 == 0)).select("source", F.lit("r:0").alias("target"), "type")
    return e.where(~(F.col("source").startswith("s:") & (key % 9 == 0))).unionByName(twice)


def inferred_shapes(spark, d):
    s = O.shapes(entities(spark, d), relationships(spark, d))
    return s.select("class", "property", F.col("min_count").cast("long").alias("min_count"), "max_count", F.array_join("ranges", ",").alias("ranges"))


def shacl_shapes(spark, d):
    return O.shacl_lines(O.shapes(entities(spark, d), places(spark, d)))


def shape_violations(spark, d):
    e = entities(spark, d)
    return O.shape_violations(e, _moved(spark, d), O.shapes(e, places(spark, d)))


def ontology_changes(spark, d):
    """Domains and ranges of each kind of edge, with and without the moves."""
    e = entities(spark, d)
    properties = lambda edges: O.infer_properties(e, edges).select("type", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"))
    return V.snapshot_diff(properties(places(spark, d)), properties(_moved(spark, d)), "type").select("type", "change", F.array_join("fields", ",").alias("fields"))


def entity_uris(spark, d):
    return entities(spark, d).select("id", O.entity_uri("https://graph.example/").alias("uri"))


def evolution_metrics(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.lit("shop").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").alias("valid_from"))
    return T.evolution_metrics(e).select("period", "edges", F.round("diversity", 6).alias("diversity"), F.round("stability", 6).alias("stability"))


def triangle_communities(spark, d):
    """Suppliers of one nation know each other."""
    home = places(spark, d).where("source LIKE 's:%'").select("source", "target")
    return G.triangle_communities(places(spark, d).select("source", "target"), home.select(F.col("source").alias("node"), F.col("target").alias("group")))


def attention_pooled(spark, d):
    return V.attention_pool(table(spark, d, "embeddings"), ["label"]).select("label", "pos", F.round("value", 5).alias("value"))


def max_pooled(spark, d):
    return V.mean_pool(table(spark, d, "embeddings"), ["label"], how="max").select("label", "pos", F.round("value", 5).alias("value"))


def scaled_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.array_max(S.softmax(F.col("embedding"))), 6).alias("softmax_max"), F.round(F.aggregate(S.min_max(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 4).alias("min_max_sum"))


Q = inferred_shapes, shacl_shapes, shape_violations, ontology_changes, entity_uris, evolution_metrics, triangle_communities, attention_pooled, max_pooled, scaled_vectors
QUERIES = {f.__name__: f for f in Q}

_SHAPES = "t AS (SELECT id, type AS c FROM entities), ou AS (SELECT t.c, r.type AS p, r.source, z.c AS rg FROM {0} r JOIN t ON t.id = r.source LEFT JOIN t z ON z.id = r.target), ec AS (SELECT c, p, source, count(*) AS n FROM ou GROUP BY ALL), sh AS (SELECT ec.c, ec.p, CASE WHEN count(*) < (SELECT count(*) FROM t WHERE t.c = ec.c) THEN 0 ELSE min(n) END AS lo, max(n) AS hi, (SELECT string_agg(DISTINCT rg, ',' ORDER BY rg) FROM ou WHERE ou.c = ec.c AND ou.p = ec.p) AS rgs FROM ec GROUP BY ec.c, ec.p)"
_MOVED = "mv AS (SELECT source, target, type FROM places WHERE NOT (source LIKE 's:%' AND split_part(source, ':', 2)::INT % 9 = 0) UNION ALL SELECT source, 'r:0', type FROM places WHERE source LIKE 'c:%' AND split_part(source, ':', 2)::INT % 10 = 0)"
ORACLE_SQL = {
    "inferred_shapes": f"WITH {SQL}, {_SHAPES.format('rels')} SELECT c AS class, p AS property, lo::BIGINT AS min_count, hi AS max_count, rgs AS ranges FROM sh",
    "shacl_shapes": f"WITH {SQL}, {_SHAPES.format('places')} SELECT 'g:' || c || 'Shape a sh:NodeShape ; sh:targetClass g:' || c || ' ; sh:property [ sh:path g:' || p || ' ; sh:minCount ' || lo || ' ; sh:maxCount ' || hi || ' ; sh:class ( g:' || replace(rgs, ',', ' g:') || ' ) ] .' AS value FROM sh",
    "shape_violations": f"WITH {SQL}, {_MOVED} SELECT 's:' || s_suppkey AS id, 'located_in' AS property, 'min_count' AS issue FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'c:' || c_custkey, 'located_in', unnest(['max_count', 'class']) FROM customer WHERE c_custkey % 10 = 0",
    "ontology_changes": f"""WITH {SQL},
  moved AS (SELECT source, target, type FROM places WHERE NOT (source LIKE 's:%' AND substr(source, 3)::INT % 9 = 0) UNION ALL SELECT source, 'r:0', type FROM places WHERE source LIKE 'c:%' AND substr(source, 3)::INT % 10 = 0),
  u AS (SELECT 0 AS side, source, target, type FROM places UNION ALL SELECT 1, source, target, type FROM moved),
  i AS (SELECT side, u.type, string_agg(DISTINCT a.type, ',' ORDER BY a.type) AS domains, string_agg(DISTINCT b.type, ',' ORDER BY b.type) AS ranges FROM u JOIN entities a ON a.id = source JOIN entities b ON b.id = target GROUP BY ALL)
  SELECT coalesce(x.type, y.type) AS type, CASE WHEN x.type IS NULL THEN 'added' WHEN y.type IS NULL THEN 'removed' ELSE 'modified' END AS change,
    concat_ws(',', CASE WHEN x.domains <> y.domains THEN 'domains' END, CASE WHEN x.ranges <> y.ranges THEN 'ranges' END) AS fields
  FROM (FROM i WHERE side = 0) x FULL JOIN (FROM i WHERE side = 1) y ON x.type = y.type WHERE x.type IS NULL OR y.type IS NULL OR x.domains <> y.domains OR x.ranges <> y.ranges""",
    "entity_uris": f"WITH {SQL} SELECT id, 'https://graph.example/' || type || '/' || left(sha256(lower(trim(name))), 16) AS uri FROM entities",
    "evolution_metrics": """WITH e AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS m, l_suppkey AS s, l_returnflag AS f FROM lineitem), k AS (SELECT m, f, count(*) AS n FROM e GROUP BY 1, 2), t AS (SELECT m, sum(n) AS edges FROM k GROUP BY 1),
      v AS (SELECT t.m, edges, -sum(n / edges::DOUBLE * log2(n / edges::DOUBLE)) AS h FROM t JOIN k USING (m) GROUP BY t.m, edges), w AS (SELECT *, lag(m) OVER (ORDER BY m) AS b, lag(edges) OVER (ORDER BY m) AS pe FROM v),
      c AS (SELECT w.m, count(*) AS kept FROM w JOIN e x ON x.m = w.m JOIN e y ON y.m = w.b AND x.s = y.s AND x.f = y.f GROUP BY w.m)
      SELECT strftime(m, '%Y-%m-%d') AS period, edges::BIGINT AS edges, round(h, 6) + 0.0 AS diversity, CASE WHEN b IS NOT NULL THEN round(coalesce(kept, 0) / (edges + pe - coalesce(kept, 0))::DOUBLE, 6) END AS stability FROM w LEFT JOIN c USING (m)""",
    "triangle_communities": "WITH h AS (SELECT 's:' || s_suppkey AS s, 'n:' || s_nationkey AS n FROM supplier), g AS (SELECT n, count(*) AS k FROM h GROUP BY n HAVING count(*) > 1) SELECT node, n AS community FROM (SELECT s AS node, n FROM h JOIN g USING (n) UNION ALL SELECT n, n FROM g)",
    "attention_pooled": """WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS mean FROM x GROUP BY 1, 2),
      s AS (SELECT vec_id, label, sum(x * mean) AS s FROM x JOIN m USING (label, pos) GROUP BY 1, 2), w AS (SELECT vec_id, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM s)
      SELECT label, pos::INT AS pos, round(sum(x * w) / sum(w), 5) AS value FROM x JOIN w USING (vec_id) GROUP BY 1, 2""",
    "max_pooled": "SELECT label, (pos - 1)::INT AS pos, round(max(x::DOUBLE), 5) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos",
    "scaled_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id, v, list_max(v) AS hi, list_min(v) AS lo FROM e)
      SELECT vec_id, round(1.0::DOUBLE / list_sum(list_transform(v, lambda x: exp(x - hi))), 6) AS softmax_max, round(list_sum(list_transform(v, lambda x: (x - lo) / (hi - lo))), 4) AS min_max_sum FROM p""",
}
