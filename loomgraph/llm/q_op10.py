"""op10: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.mixing import mix_sources
from loomgraph.runtime import spread


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents; null texts, ids and sources and repeated rows as in ``mix_sources``."""
    return mix_sources(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op10_mix_sources": op10_mix_sources}

#: One global window for each running total: the same order and cut, on one node.
ORACLE_SQL = {
    "op10_mix_sources": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h, md5(coalesce(text, '')) AS th
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY cap / CAST(w AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target,
             sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, th ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.k = t.k),
e AS (SELECT c.*, x.e, (CAST(cum AS BIGINT) + x.e * source_size) / target AS f FROM c, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY f, k, h, doc_id, th, e ROWS UNBOUNDED PRECEDING) AS run FROM e),
n AS (SELECT doc_id, k, th, cum, count(*) AS copies FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(n.copies, 0) AS BIGINT) AS taken,
  CASE WHEN c.target > 0 THEN CAST(c.cum AS BIGINT) / c.target ELSE 0.0 END AS finish
FROM c LEFT JOIN n ON c.doc_id IS NOT DISTINCT FROM n.doc_id AND c.k = n.k AND c.th = n.th AND c.cum = n.cum AND c.size > 0
"""
}
