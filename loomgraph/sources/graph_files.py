"""Graphs as lines of text: N-Triples, Turtle, JSON-LD, Cypher, AQL, GraphML, GEXF and DOT; tasks write their own part
files, so a format's opening and closing lines are columns of their own (``frame``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMESPACE = "urn:graph:"


def _escaped(c: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _ticked(c: str) -> Column:
    """A name as it may stand between backticks."""
    return F.replace(F.col(c), F.lit("`"), F.lit("``"))


#: What an address must not hold, and the sign that codes it.
CODED = "%<>\"{}|^`\\ \n\r\t"


def _address(c: Column) -> Column:
    for sign in CODED:
        c = F.replace(c, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return c


def _from_address(c: Column) -> Column:
    for sign in reversed(CODED):
        c = F.replace(c, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return c


def ntriples(edges: DataFrame) -> DataFrame:
    """(value): a line for each edge whose source, type and target are not null; signs that addresses must not hold are
    percent-coded."""
    iri = lambda c: F.concat(F.lit(f"<{NAMESPACE}"), _address(F.col(c)), F.lit(">"))
    return edges.dropna(subset=["source", "type", "target"]).select(F.concat(iri("source"), F.lit(" "), iri("type"), F.lit(" "), iri("target"), F.lit(" .")).alias("value"))


def cypher(entities: DataFrame) -> DataFrame:
    """(value): a CREATE statement for each entity that has an id and a type; a null name is an empty one."""
    name = _escaped(F.coalesce("name", F.lit("")))
    return entities.dropna(subset=["id", "type"]).select(F.concat(F.lit("CREATE (:`"), _ticked("type"), F.lit('` {id: "'), _escaped(F.col("id")), F.lit('", name: "'), name, F.lit('"});')).alias("value"))


def cypher_relationships(edges: DataFrame) -> DataFrame:
    """(value): a MATCH and CREATE statement for each edge with both ends and a type."""
    end = lambda v, c: F.concat(F.lit(f'({v} {{id: "'), _escaped(F.col(c)), F.lit('"})'))
    return edges.dropna(subset=["source", "type", "target"]).select(F.concat(F.lit("MATCH "), end("a", "source"), F.lit(", "), end("b", "target"), F.lit(" CREATE (a)-[:`"), _ticked("type"), F.lit("`]->(b);")).alias("value"))


def aql(entities: DataFrame, batch: int = 1000) -> DataFrame:
    """(value): an INSERT statement for ``batch`` entities that have an id and a type, in the order of ids within parts of
    the table; a null name is an empty one."""
    quoted = lambda c: F.concat(F.lit('"'), _escaped(c), F.lit('"'))
    document = F.concat(F.lit("{_key: "), quoted(F.col("id")), F.lit(", type: "), quoted(F.col("type")), F.lit(", name: "), quoted(F.coalesce("name", F.lit(""))), F.lit("}"))
    rows = entities.dropna(subset=["id", "type"]).select("id", document.alias("_doc"))
    part = F.floor((F.row_number().over(W.partitionBy(F.pmod(F.xxhash64("id"), F.lit(1024))).orderBy("id")) - 1) / batch)
    batches = rows.withColumn("_hash", F.pmod(F.xxhash64("id"), F.lit(1024))).withColumn("_part", part).groupBy("_hash", "_part").agg(F.array_join(F.array_sort(F.collect_list("_doc")), ", ").alias("_docs"))
    return batches.select(F.concat(F.lit("FOR d IN ["), F.col("_docs"), F.lit("] INSERT d INTO entities")).alias("value"))


def turtle(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a line with type and label for each entity that has an id and a type, and one for each whole edge, in
    prefixed names; ``frame("turtle")`` has the prefixes. Characters that prefixed names do not allow are percent-coded."""
    node = F.concat(F.lit("g:"), _local("id"), F.lit(" a g:"), _local("type"), F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit(' ; rdfs:label "'), _escaped(F.col("name")), F.lit('"'))), F.lit(" ."))
    edge = F.concat(F.lit("g:"), _local("source"), F.lit(" g:"), _local("type"), F.lit(" g:"), _local("target"), F.lit(" ."))
    return entities.dropna(subset=["id", "type"]).select(node.alias("value")).unionByName(edges.dropna(subset=["source", "type", "target"]).select(edge.alias("value")))


def _local(c: str) -> Column:
    return F.replace(F.replace(F.url_encode(F.col(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def json_ld(entities: DataFrame) -> DataFrame:
    """(value): one JSON-LD object a line for each entity that has an id."""
    return entities.dropna(subset=["id"]).select(F.to_json(F.struct(F.concat(F.lit(NAMESPACE), "id").alias("@id"), F.concat(F.lit(NAMESPACE), "type").alias("@type"), F.col("name").alias("rdfs:label"))).alias("value"))


def read_json_ld(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, name) of lines that ``json_ld`` gives; other lines are left out."""
    x = F.from_json("value", "`@id` string, `@type` string, `rdfs:label` string")
    plain = lambda c: F.regexp_replace(c, f"^{NAMESPACE}", "")
    return spark.read.text(path).select(x.alias("x")).select(plain(F.col("x.`@id`")).alias("id"), plain(F.col("x.`@type`")).alias("type"), F.col("x.`rdfs:label`").alias("name")).where("id IS NOT NULL")


def _xml(c: str) -> Column:
    out = F.coalesce(F.col(c), F.lit(""))
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def graphml_nodes(entities: DataFrame) -> DataFrame:
    """(value): a node element with type and name for each entity with an id."""
    return entities.dropna(subset=["id"]).select(F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="type">'), _xml("type"), F.lit('</data><data key="name">'), _xml("name"), F.lit("</data></node>")).alias("value"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    """(value): an edge element for each edge with both ends."""
    return edges.dropna(subset=["source", "target"]).select(F.concat(F.lit('<edge source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('" label="'), _xml("type"), F.lit('"/>')).alias("value"))


def gexf_nodes(entities: DataFrame) -> DataFrame:
    """(value): a node element for each entity with an id."""
    return entities.dropna(subset=["id"]).select(F.concat(F.lit('<node id="'), _xml("id"), F.lit('" label="'), _xml("name"), F.lit('"/>')).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """(value): an edge statement for each edge with both ends."""
    name = lambda c: F.concat(F.lit('"'), _escaped(F.coalesce(F.col(c), F.lit(""))), F.lit('"'))
    return edges.dropna(subset=["source", "target"]).select(F.concat(F.lit("  "), name("source"), F.lit(" -> "), name("target"), F.lit(" [label="), name("type"), F.lit("];")).alias("value"))


#: What stands before and after the lines of a format.
FRAMES = {
    "turtle": (f"@prefix g: <{NAMESPACE}> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", ""),
    "graphml": ('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="node" attr.name="type" attr.type="string"/><key id="name" for="node" attr.name="name" attr.type="string"/><graph edgedefault="directed">', "</graph></graphml>"),
    "gexf": ('<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">', "</graph></gexf>"),
    "dot": ("digraph g {", "}"),
}


def frame(kind: str) -> tuple[str, str]:
    """Opening and closing lines of a format."""
    return FRAMES[kind]


#: The columns of entity tables and the names under which they may come, the first that has a value counts.
CSV_ALIASES = {"id": ("id", "entity_id"), "text": ("text", "name", "label"), "type": ("type", "entity_type"), "start": ("start", "start_char"), "end": ("end", "end_char"), "confidence": ("confidence", "score")}


def csv_entities(entities: DataFrame) -> DataFrame:
    """The columns of CSV_ALIASES as text, each from the first of its aliases that has a value, else empty."""
    pick = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in entities.columns], F.lit(""))
    return entities.select(*[pick(names).alias(c) for c, names in CSV_ALIASES.items()])


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.write.option("compression", compression).text(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(source, type, target) of lines of the form that ``ntriples`` gives; other lines are left out."""
    pattern = rf"^<{NAMESPACE}([^>]*)> <{NAMESPACE}([^>]*)> <{NAMESPACE}([^>]*)> \.$"
    part = lambda i: _from_address(F.regexp_extract("value", pattern, i))
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("source"), part(2).alias("type"), part(3).alias("target"))
