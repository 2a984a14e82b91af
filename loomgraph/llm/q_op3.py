"""op3: documents linked by three-word shingles at a similarity of 0.9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.ngram_join import link_documents
from loomgraph.runtime import spread


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents; null texts, texts without words and repeated rows as in ``link_documents``."""
    return link_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), width=3, num=90, den=100)


QUERIES = {"op3_ngram_join": op3_ngram_join}
