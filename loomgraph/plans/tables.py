"""The canonical entity and relationship tables over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name) of regions, nations, customers, suppliers and parts, ids prefixed by table."""
    parts = []
    for name, prefix in (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p")):
        key, label = ("p_partkey", "p_name") if name == "part" else (f"{prefix}_{name[:4] if name in ('customer', 'supplier') else name}key", f"{prefix}_name")
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}.get(name, key)
        parts.append(table(spark, sf_dir, name).select(F.concat(F.lit(prefix + ":"), F.col(key).cast("string")).alias("id"), F.lit(name).alias("type"), F.col(label).alias("name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, type, weight, valid_from): places, and suppliers with the parts they ship."""
    def edge(df: DataFrame, source, target, kind: str, weight=None, valid_from=None) -> DataFrame:
        a, b = (F.concat(F.lit(p + ":"), F.col(c).cast("string")) for p, c in (source, target))
        return df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), (valid_from if valid_from is not None else F.lit(None).cast("timestamp_ntz")).alias("valid_from"))

    shipped = dealt(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.min("l_shipdate").alias("since"))
    return (
        edge(table(spark, sf_dir, "nation"), ("n", "n_nationkey"), ("r", "n_regionkey"), "part_of")
        .unionByName(edge(table(spark, sf_dir, "customer"), ("c", "c_custkey"), ("n", "c_nationkey"), "located_in"))
        .unionByName(edge(table(spark, sf_dir, "supplier"), ("s", "s_suppkey"), ("n", "s_nationkey"), "located_in"))
        .unionByName(edge(shipped, ("s", "l_suppkey"), ("p", "l_partkey"), "supplies", F.col("q"), F.col("since")))
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships among customers, suppliers, nations and regions: a forest."""
    return relationships(spark, sf_dir).where("type <> 'supplies'")


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) of the relationships, shipments once for each line: for what tells edges apart itself."""
    line = table(spark, sf_dir, "lineitem")
    shipped = line.select(*[F.concat(F.lit(p + ":"), F.col(c).cast("string")).alias(n) for p, c, n in (("s", "l_suppkey", "source"), ("p", "l_partkey", "target"))])
    return places(spark, sf_dir).select("source", "target").unionByName(shipped)


#: The same tables in SQL, for the DuckDB side.
SQL = """
entities AS (
  SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part', p_name FROM part),
rels AS (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'part_of' AS type, 1.0::DOUBLE AS weight, NULL::TIMESTAMP AS valid_from FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in', 1.0::DOUBLE, NULL FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', 1.0::DOUBLE, NULL FROM supplier
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'supplies', sum(l_quantity)::DOUBLE, min(l_shipdate)::TIMESTAMP FROM lineitem GROUP BY l_suppkey, l_partkey),
places AS (SELECT * FROM rels WHERE type <> 'supplies'),
und AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM rels UNION ALL SELECT target, source FROM rels) WHERE a <> b),
pund AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM places UNION ALL SELECT target, source FROM places) WHERE a <> b)
"""
