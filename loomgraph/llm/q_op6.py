"""op6: the five nearest neighbours of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.ann import nearest


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows for every query row that takes part (all candidates, if fewer); see ``nearest`` for nulls, zeros and
    repeated ids."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
