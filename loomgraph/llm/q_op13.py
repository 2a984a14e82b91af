"""op13: periodic runs of words in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.runs import find_word_runs
from loomgraph.runtime import spread


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents, repeated ones included; a null text has no words. A null id plants no repetition."""
    return find_word_runs(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), planted=True)


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
