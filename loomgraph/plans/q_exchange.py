"""Queries of ontology inference, seed merging, lineage, graph files and streaming ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import ontology as O
from loomgraph.plans.tables import SQL, entities, places, relationships, table
from loomgraph.runtime import shared_dir
from loomgraph.sources import graph_files as G
from loomgraph.streaming.ingest import ingest


def inferred_classes(spark, d):
    return O.infer_classes(entities(spark, d), 20)


def inferred_properties(spark, d):
    found = O.infer_properties(entities(spark, d), relationships(spark, d))
    return found.select("type", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"), "n")


def _seeds(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    missing = F.when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return p.where("p_partkey % 3 <> 0").withColumn("p_size", missing), p.where("p_partkey % 5 <> 0").withColumn("p_brand", F.lower("p_brand"))


def seeds_merged(spark, d):
    return O.merge_seeds(*_seeds(spark, d), "p_partkey", "merge")


def seeds_extracted_first(spark, d):
    return O.merge_seeds(*_seeds(spark, d), "p_partkey", "extracted_first")


def lineage_of_places(spark, d):
    return O.lineage(places(spark, d).select(F.col("source").alias("id"), F.col("target").alias("parent")))


def ntriples_round_trip(spark, d):
    path = f"{shared_dir(spark)}/loomgraph-nt-{uuid.uuid4().hex}"
    G.write_lines(G.ntriples(relationships(spark, d)), path)
    return G.read_ntriples(spark, path)


def cypher_statements(spark, d):
    return G.cypher(entities(spark, d))


def graphml_elements(spark, d):
    return G.graphml_edges(relationships(spark, d))


def graphml_node_elements(spark, d):
    return G.graphml_nodes(entities(spark, d))


def gexf_elements(spark, d):
    return G.gexf_nodes(entities(spark, d))


def dot_statements(spark, d):
    return G.dot(places(spark, d))


def cypher_relationship_statements(spark, d):
    return G.cypher_relationships(places(spark, d))


def turtle_lines(spark, d):
    return G.turtle(entities(spark, d), relationships(spark, d))


def json_ld_round_trip(spark, d):
    path = f"{shared_dir(spark)}/loomgraph-ld-{uuid.uuid4().hex}"
    G.write_lines(G.json_ld(entities(spark, d)), path)
    return G.read_json_ld(spark, path)


def aql_documents(spark, d):
    """Documents inserted by all batches, and the most in one of them."""
    n = F.size(F.split("value", r"\}, \{"))
    return G.aql(entities(spark, d), 1000).agg(F.sum(n).alias("documents"), (F.max(n) <= 1000).alias("within"))


def csv_rows(spark, d):
    return G.csv_entities(entities(spark, d).withColumnsRenamed({"id": "entity_id"}))


def streamed_events(spark, d):
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a pattern may match a file or a folder
    rows = ingest(stream, {"kind": F.col("event_type") != "error", "value": F.col("value") >= 5})
    return rows.groupBy("event_type", F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


Q = (inferred_classes, inferred_properties, seeds_merged, seeds_extracted_first, lineage_of_places, ntriples_round_trip, cypher_statements, graphml_elements, graphml_node_elements, gexf_elements, dot_statements, cypher_relationship_statements, turtle_lines, json_ld_round_trip, aql_documents, csv_rows, streamed_events)
QUERIES = {f.__name__: f for f in Q}

_SEEDS = """s AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0),
  e AS (SELECT p_partkey, lower(p_brand) AS p_brand, p_size FROM part WHERE p_partkey % 5 <> 0)"""
ORACLE_SQL = {
    "inferred_classes": f"WITH {SQL} SELECT type, count(*) AS n FROM entities GROUP BY type HAVING count(*) >= 20",
    "inferred_properties": f"WITH {SQL} SELECT r.type, string_agg(DISTINCT a.type, ',' ORDER BY a.type) AS domains, string_agg(DISTINCT b.type, ',' ORDER BY b.type) AS ranges, count(*) AS n FROM rels r LEFT JOIN entities a ON r.source = a.id LEFT JOIN entities b ON r.target = b.id GROUP BY r.type",
    "seeds_merged": f"WITH {_SEEDS} SELECT p_partkey, coalesce(s.p_brand, e.p_brand) AS p_brand, coalesce(s.p_size, e.p_size) AS p_size FROM s FULL JOIN e USING (p_partkey)",
    "seeds_extracted_first": f"WITH {_SEEDS} SELECT * FROM e UNION ALL SELECT * FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM e)",
    "lineage_of_places": f"WITH RECURSIVE {SQL}, c AS (SELECT source AS id, target AS ancestor, 1 AS depth FROM places UNION SELECT c.id, p.target, c.depth + 1 FROM c JOIN places p ON c.ancestor = p.source) SELECT id, ancestor, min(depth) AS depth FROM c GROUP BY id, ancestor",
    "ntriples_round_trip": f"WITH {SQL} SELECT source, type, target FROM rels",
    "cypher_statements": f"WITH {SQL} SELECT 'CREATE (:`' || type || '` {{id: \"' || id || '\", name: \"' || name || '\"}});' AS value FROM entities",
    "graphml_elements": f"WITH {SQL} SELECT '<edge source=\"' || source || '\" target=\"' || target || '\" label=\"' || type || '\"/>' AS value FROM rels",
    "graphml_node_elements": f"WITH {SQL} SELECT '<node id=\"' || id || '\"><data key=\"type\">' || type || '</data><data key=\"name\">' || name || '</data></node>' AS value FROM entities",
    "gexf_elements": f"WITH {SQL} SELECT '<node id=\"' || id || '\" label=\"' || name || '\"/>' AS value FROM entities",
    "dot_statements": f"WITH {SQL} SELECT '  \"' || source || '\" -> \"' || target || '\" [label=\"' || type || '\"];' AS value FROM places",
    "cypher_relationship_statements": f"WITH {SQL} SELECT 'MATCH (a {{id: \"' || source || '\"}}), (b {{id: \"' || target || '\"}}) CREATE (a)-[:`' || type || '`]->(b);' AS value FROM places",
    "turtle_lines": f"WITH {SQL} SELECT 'g:' || replace(id, ':', '%3A') || ' a g:' || type || ' ; rdfs:label \"' || name || '\" .' AS value FROM entities UNION ALL SELECT 'g:' || replace(source, ':', '%3A') || ' g:' || type || ' g:' || replace(target, ':', '%3A') || ' .' FROM rels",
    "json_ld_round_trip": f"WITH {SQL} SELECT id, type, name FROM entities",
    "aql_documents": f"WITH {SQL} SELECT count(*) AS documents, true AS within FROM entities",
    "csv_rows": f"WITH {SQL} SELECT id, name AS text, type, '' AS start, '' AS \"end\", '' AS confidence FROM entities",
    "streamed_events": "SELECT event_type, CASE WHEN event_type = 'error' THEN 'kind' WHEN value >= 5 THEN 'good' ELSE 'value' END AS reason, count(*) AS n FROM events GROUP BY ALL",
}
