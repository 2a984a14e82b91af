"""Queries of average-linkage clusters and first-come clusters of part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import alignment as A
from loomgraph.operators import clustering as K
from loomgraph.plans.tables import table


def _names(spark, d):
    """The distinct names of parts with their types, and all pairs of a TF-IDF cosine of 0.3 or more, to 9 digits."""
    label = A.plain_label(F.concat_ws(" ", "p_name", "p_type"))
    names = table(spark, d, "part").select(label.alias("label")).distinct()
    pairs = A.similar_labels(names, names, least=0.3).where("a < b").select("a", "b", F.round("cosine", 9).alias("similarity"))
    return names.select(F.col("label").alias("node")), pairs


def linked_names(spark, d):
    return K.average_linkage(*_names(spark, d), threshold=0.4)[0]


def first_come_names(spark, d):
    return K.first_come_clusters(*_names(spark, d), threshold=0.5)


QUERIES = {f.__name__: f for f in (linked_names, first_come_names)}

#: One node after the other, with the list of leaders so far.
ORACLE_SQL = {
    "first_come_names": r"""WITH RECURSIVE
u AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS label FROM part),
w AS (SELECT label, ' ' || unnest(string_split(label, ' ')) || ' ' AS w FROM u),
g AS (SELECT label, w[i:i + n - 1] AS gram FROM (SELECT label, w, n, unnest(generate_series(1, length(w) - n + 1)) AS i FROM w, (VALUES (2), (3), (4)) v(n))),
c AS (SELECT label, gram, count(*) AS tf FROM g GROUP BY ALL),
f AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM u)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY gram),
v AS (SELECT label, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY label)) AS weight FROM c JOIN f USING (gram)),
p AS (SELECT x.label AS a, y.label AS b FROM v x JOIN v y ON x.gram = y.gram AND x.label > y.label GROUP BY ALL HAVING round(sum(x.weight * y.weight), 9) >= 0.5),
o AS (SELECT label, row_number() OVER (ORDER BY label) AS k, coalesce((SELECT list(b ORDER BY b) FROM p WHERE a = label), []) AS near FROM u),
r AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS leaders, NULL::VARCHAR AS node, NULL::VARCHAR AS leader
  UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(o.near, lambda x: list_contains(r.leaders, x))) = 0 THEN list_append(r.leaders, o.label) ELSE r.leaders END, o.label,
         coalesce(list_filter(o.near, lambda x: list_contains(r.leaders, x))[1], o.label)
  FROM r JOIN o ON o.k = r.k + 1)
SELECT node, leader FROM r WHERE k > 0""",
}
