"""Ontology, seeds, lineage, graph files and streaming on awkward rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import ontology as O
from loomgraph.operators import text as X
from loomgraph.sources import graph_files as G
from loomgraph.streaming.ingest import ingest


def test_lineage_ends_in_cycles_and_skips_nulls(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), (None, "a"), ("y", None), ("a", "b")], "id string, parent string")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in O.lineage(links).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2}
    assert O.lineage(links.limit(0)).count() == 0


def test_properties_without_known_ends(spark):
    nodes = spark.createDataFrame([("a", "t"), ("b", None)], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "k"), ("a", "gone", "k")], "source string, target string, type string")
    assert [tuple(r) for r in O.infer_properties(nodes, edges).collect()] == [("k", ["t"], [], 2)]
    assert O.infer_classes(nodes, 1).count() == 1


def test_seed_strategies(spark):
    seeds = spark.createDataFrame([(1, "s", None), (2, "s", 2)], "id int, a string, b int")
    found = spark.createDataFrame([(1, "e", 1), (3, None, 3)], "id int, a string, b int")
    got = lambda how: sorted(tuple(r) for r in O.merge_seeds(seeds, found, "id", how).collect())
    assert got("seed_first") == [(1, "s", None), (2, "s", 2), (3, None, 3)]
    assert got("extracted_first") == [(1, "e", 1), (2, "s", 2), (3, None, 3)]
    assert got("merge") == [(1, "s", 1), (2, "s", 2), (3, None, 3)]


def test_text_lines_escape(spark):
    nodes = spark.createDataFrame([("i", "T", 'a"\\\nb'), (None, "T", "x"), ("j", "T", None)], "id string, type string, name string")
    lines = [r[0] for r in G.cypher(nodes).collect()]
    assert lines == ['CREATE (:`T` {id: "i", name: "a\\"\\\\\\nb"});', 'CREATE (:`T` {id: "j", name: ""});']
    edges = spark.createDataFrame([("a<&", "b", None), (None, "b", "k")], "source string, target string, type string")
    assert [r[0] for r in G.graphml_edges(edges).collect()] == ['<edge source="a&lt;&amp;" target="b" label=""/>']
    assert G.ntriples(edges).count() == 0


def test_names_cannot_leave_their_place(spark, tmp_path):
    odd = 'a` b>%3C"\\'
    nodes = spark.createDataFrame([("i", "T`", "n")], "id string, type string, name string")
    assert [r[0] for r in G.cypher(nodes).collect()] == ['CREATE (:`T``` {id: "i", name: "n"});']
    edges = spark.createDataFrame([("x", odd, "y"), (odd, "t", odd)], "source string, type string, target string")
    assert "[:`a`` b" in "".join(r[0] for r in G.cypher_relationships(edges).collect())
    G.write_lines(G.ntriples(edges), str(tmp_path / "nt"))
    assert sorted(map(tuple, G.read_ntriples(spark, str(tmp_path / "nt")).collect())) == sorted(map(tuple, edges.collect()))
    shapes = spark.createDataFrame([("C d", "p]", 1, 2, ["R ."])], "class string, property string, min_count int, max_count int, ranges array<string>")
    assert [r[0] for r in O.shacl_lines(shapes).collect()] == ["g:C%20dShape a sh:NodeShape ; sh:targetClass g:C%20d ; sh:property [ sh:path g:p%5D ; sh:minCount 1 ; sh:maxCount 2 ; sh:class ( g:R%20. ) ] ."]


def test_relations_of_long_lists_of_names(spark):
    text = "Ann Bo " * 4_000 + "is located in Big Town and Ann Bo founded by Cy."
    found = X.extract_relations(spark.createDataFrame([(1, text)], "id int, text string"), "text").collect()
    assert sorted((r["relation"], len(r["subject"]), r["object"]) for r in found) == [("founded_by", 6, "Cy"), ("located_in", 27_999, "Big Town")]


def test_stream_takes_new_files_only(spark, tmp_path):
    schema = "id long, v string"
    spark.createDataFrame([(1, "a"), (2, None)], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"v": F.col("v") != "bad"}, str(tmp_path / "out"))
    assert {r["id"]: r["reason"] for r in run().collect()} == {1: None, 2: "v"}
    spark.createDataFrame([(3, "bad"), (4, "c")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert {r["id"]: r["reason"] for r in run().collect()} == {1: None, 2: "v", 3: "v", 4: None}
