"""op12: exact copies of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.exact_dedup import exact_dedup
from loomgraph.runtime import spread


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents, dropped ones too; null texts, null ids and repeated rows as in ``exact_dedup``."""
    return exact_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op12_exact_dedup": op12_exact_dedup}

#: Grouped by the texts themselves; ids are compared with null as the smallest, and of rows that repeat the owner one is kept.
ORACLE_SQL = {
    "op12_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS k
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM w
"""
}
