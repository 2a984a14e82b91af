"""Queries of hybrid retrieval: one order over what vectors, a graph and memory find."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import retrieval as V
from loomgraph.plans.tables import table


def hybrid_retrieval(spark, d):
    """For each nation: customers that memory holds by what they ordered last, the graph by where they live, and vectors by
    balances near the nation's mean; ten of each, the five best in all."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("query"), F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), "c_acctbal")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    known = c.join(o, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    mean = c.groupBy("query").agg(F.sum(cents).alias("total"), F.count("*").alias("many"))
    near = -F.abs(cents * F.col("many") - F.col("total")).cast("double")  # in whole cents, so the same in every order of summing
    vector = known.join(mean, "query").withColumn("s", near)
    graph = known.withColumn("s", F.col("n").cast("double"))
    memory = known.where("latest IS NOT NULL").withColumn("s", F.datediff("latest", F.lit("1990-01-01").cast("date")).cast("double"))

    def ten(df, origin, related, similarity):
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("s"), "id"))
        return df.withColumn("k", rank).where("k <= 10").select("query", F.lit(origin).alias("origin"), "id", "content", F.col("s").alias("score"), related.alias("related"), similarity.alias("similarity"))

    share = (F.col("id") % 7) / 7.0
    every = ten(vector, "vector", F.lit(0), F.lit(None).cast("double")).unionByName(ten(graph, "graph", F.col("n"), share)).unionByName(ten(memory, "memory", F.lit(0), F.lit(None).cast("double")))
    return V.rank_and_merge(every, 5, 0.6, 0.05).withColumn("score", F.round("score", 6))


QUERIES = {"hybrid_retrieval": hybrid_retrieval}

ORACLE_SQL = {
    "hybrid_retrieval": """WITH o AS (SELECT o_custkey AS id, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1),
c AS (SELECT c_nationkey::BIGINT AS query, c_custkey AS id, c_name AS content, round(c_acctbal * 100)::BIGINT AS cents, coalesce(n, 0) AS n, latest, sum(round(c_acctbal * 100)::BIGINT) OVER w AS total, count(*) OVER w AS many FROM customer LEFT JOIN o ON o.id = c_custkey WINDOW w AS (PARTITION BY c_nationkey)),
a AS (SELECT 'vector' AS origin, query, id, content, -abs(cents * many - total)::DOUBLE AS s, 0 AS related, NULL::DOUBLE AS similarity FROM c
 UNION ALL SELECT 'graph', query, id, content, n::DOUBLE, n, (id % 7) / 7.0 FROM c
 UNION ALL SELECT 'memory', query, id, content, date_diff('day', DATE '1990-01-01', latest::DATE)::DOUBLE, 0, NULL FROM c WHERE latest IS NOT NULL),
t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query, origin ORDER BY s DESC, id) <= 10),
z AS (SELECT *, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE s END AS u FROM t WINDOW w AS (PARTITION BY query, origin)),
y AS (SELECT *, CASE origin WHEN 'vector' THEN 0.4 * u WHEN 'memory' THEN 0.3 * u ELSE 0.6 * u + least(0.2, 0.01 * related) END AS v FROM z),
x AS (SELECT query, origin, id, content, 0.7 * v + 0.3 * similarity AS score FROM y WHERE origin = 'graph'
 UNION ALL SELECT query, origin, id, content, v FROM y WHERE origin <> 'graph' QUALIFY row_number() OVER (PARTITION BY query, content ORDER BY v DESC, origin, id) = 1)
SELECT query, origin, id, content, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, origin, id, content) AS rank FROM x WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, origin, id, content) <= 5""",
}
