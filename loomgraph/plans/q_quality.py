"""Queries of record cleaning, conflicts and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import cleaning as C
from loomgraph.operators import conflicts as K
from loomgraph.operators import dedup as D
from loomgraph.plans.tables import table

#: Pieces of the parts of one name and brand.
PIECES = 4


def _gappy(spark, d):
    """Parts with sizes and brands missing by a rule."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return p.withColumns({"p_size": F.when(F.col("p_size") % 7 != 0, F.col("p_size")), "p_brand": F.when(F.col("p_partkey") % 11 == 0, "N/A").otherwise(F.col("p_brand"))})


def missing_profile(spark, d):
    return C.missing_profile(_gappy(spark, d)).select("field", "missing", F.round("percent", 6).alias("percent"))


def drop_missing(spark, d):
    return C.drop_missing(_gappy(spark, d), ["p_size", "p_brand"]).select("p_partkey", "p_size")


def fill_missing(spark, d):
    return C.fill_missing(_gappy(spark, d), {"p_size": 0, "p_brand": "unknown"}).select("p_partkey", "p_brand", F.col("p_size").cast("int").alias("p_size"))


def impute_mean(spark, d):
    return C.impute(_gappy(spark, d), "p_size", "mean").select("p_partkey", F.round("p_size", 6).alias("p_size"))


def impute_median(spark, d):
    return C.impute(_gappy(spark, d), "p_size", "median").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))


RULES = {"p_size": {"required": True, "type": "int", "min": 5}, "p_brand": {"pattern": r"^Brand#\d+$", "max_length": 7}, "p_type": {"choices": ["ECONOMY", "SMALL", "PROMO"]}}


def validate_records(spark, d):
    bad = C.validate(_gappy(spark, d), RULES).where(F.size("errors") > 0)
    return bad.select("p_partkey", F.array_join("errors", "; ").alias("errors"))


def keep_first(spark, d):
    return C.keep_first(table(spark, d, "part"), ["p_name", "p_brand"], ["p_partkey"]).select("p_name", "p_brand", "p_partkey")


def merge_duplicate_records(spark, d):
    return C.merge_duplicates(_gappy(spark, d), ["p_name", "p_type"], ["p_partkey"]).select("p_name", "p_type", "p_partkey", "p_size")


def _obs(spark, d):
    """Parts of one name as sources that disagree."""
    p = table(spark, d, "part").withColumn("confidence", (F.col("p_partkey") % 10 + 1) / 10)
    return K.observations(p, ["p_type", "p_size", "p_retailprice"], "p_name", "p_brand", "confidence")


def _order_obs(spark, d):
    return K.observations(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey", "o_orderpriority", None, "o_orderdate")


def value_conflicts(spark, d):
    c = K.value_conflicts(_obs(spark, d))
    return c.select("id", "property", "n", F.size("values").cast("long").alias("distinct_values"), F.size("sources").cast("long").alias("sources"), F.round("confidence", 6).alias("confidence"), "severity")


def type_conflicts(spark, d):
    p = table(spark, d, "part")
    return K.type_conflicts(p, "p_name", "p_type").select("id", F.array_join("types", ",").alias("types"))


def relationship_conflicts(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("supplies").alias("type"), "l_returnflag", "l_linestatus")
    return K.relationship_conflicts(e, ["l_returnflag", "l_linestatus"]).select("source", "target", F.array_join("differing", ",").alias("differing"))


def _resolved(method):
    def run(spark, d):
        credibility = table(spark, d, "part").groupBy(F.col("p_brand").alias("source")).agg((F.avg("p_size") / 50).alias("credibility")) if method == "credibility_weighted" else None
        r = K.resolve(_obs(spark, d), method, credibility)
        return r.select("id", "property", "value", F.round("confidence", 6).alias("confidence"))

    return run


def resolve_recent(spark, d):
    return K.resolve(_order_obs(spark, d), "most_recent").select("id", "property", "value", "confidence")


def conflict_report(spark, d):
    return K.conflict_report(K.value_conflicts(_obs(spark, d)))


def observation_trend(spark, d):
    return K.monthly_trend(_order_obs(spark, d))


def source_disagreement(spark, d):
    o = _obs(spark, d)
    return K.source_disagreement(o, K.resolve(o, "voting")).select("source", "observations", "disagreements", F.round("credibility", 6).alias("credibility"))


def _names(spark, d):
    """Distinct part names of each brand as entities (type: the brand)."""
    p = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"), F.max("p_size").alias("size"))
    return p.select("id", F.col("p_brand").alias("type"), F.col("p_name").alias("name"), "size")


def block_pairs(spark, d):
    return D.block_pairs(_names(spark, d))


def detect_duplicates(spark, d):
    return D.detect_duplicates(_names(spark, d), 0.7).select("l_id", "r_id", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


def detect_duplicates_bigram(spark, d):
    return D.detect_duplicates(_names(spark, d), 0.6, "bigram").select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def detect_duplicates_jaro_winkler(spark, d):
    return D.detect_duplicates(_names(spark, d), 0.9, "jaro_winkler").select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def detect_incremental(spark, d):
    n = _names(spark, d)
    found = D.detect_incremental(n.where("id % 10 = 3"), n.where("id % 10 <> 3"), 0.7)
    return found.select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def duplicate_groups(spark, d):
    return D.groups(D.detect_duplicates(_names(spark, d), 0.8))


def merged_entities(spark, d):
    n = _names(spark, d)
    return D.merge_groups(n, D.groups(D.detect_duplicates(n, 0.8)), "keep_first").select("id", "type", "name", "size", "merged")


def merged_relationships(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("subject"), F.concat(F.lit(" "), F.upper("event_type")).alias("predicate"), F.get_json_object("props", "$.k").alias("object"))
    return D.merge_relationships(t, {"view": "click"}).select("subject", "predicate", "object", "id", "merged")


def impute_zero(spark, d):
    return C.impute(_gappy(spark, d), "p_size", "zero").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))


def cleaned_records(spark, d):
    return C.clean(_gappy(spark, d), ["p_name", "p_type"], ["p_partkey"]).select("p_name", "p_type", "p_partkey")


def resolve_first_seen(spark, d):
    return K.resolve(_order_obs(spark, d), "first_seen").select("id", "property", "value", "confidence")


def temporal_conflicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), "o_orderpriority")
    c = K.temporal_conflicts(K.observations(o, ["start_date"], "o_custkey", "o_orderpriority"))
    return c.select("id", "n", F.array_join("values", ",").alias("years"), "severity")


def logical_conflicts(spark, d):
    kind = F.when(F.col("p_size") < 20, "Person").when(F.col("p_size") < 35, "Organization").otherwise("Location")
    p = table(spark, d, "part").select(F.col("p_name").alias("id"), kind.alias("type"))
    return K.logical_conflicts(p)


def review_work(spark, d):
    return K.manual_review(K.value_conflicts(_obs(spark, d))).select("id", "property", "question", F.array_join("sources", ",").alias("sources"), "priority")


def best_duplicates_of_each(spark, d):
    return D.top_k_per_entity(D.detect_duplicates(_names(spark, d), 0.7), 1).select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def duplicate_group_quality(spark, d):
    c = D.detect_duplicates(_names(spark, d), 0.8)
    return D.group_summary(c, D.groups(c)).select("group", "size", *[F.round(x, 6).alias(x) for x in ("mean_similarity", "confidence")], "quality")


def updated_groups(spark, d):
    """Groups at 0.9, then the candidates from 0.8 on."""
    c = D.detect_duplicates(_names(spark, d), 0.8)
    return D.update_groups(D.groups(c.where("similarity >= 0.9")), c.where("similarity < 0.9"))


def merged_values(spark, d):
    n = _names(spark, d)
    return D.merge_all(n, D.groups(D.detect_duplicates(n, 0.8))).select("id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in ("type", "name", "size")], "merged")


def merge_gain(spark, d):
    n = _names(spark, d)
    after = D.merge_groups(n, D.groups(D.detect_duplicates(n, 0.8)), "keep_most_complete")
    return D.merge_quality(n, after).select("rows_before", F.round("filled_before", 6).alias("filled_before"), "rows_after", F.round("filled_after", 6).alias("filled_after"))


def duplicate_relationships(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.concat(F.lit(" Is  "), "p_type").alias("predicate"), F.col("p_name").alias("object"))
    return D.duplicate_relationships(p, {}, 0.8).select("l_id", "r_id", F.round("similarity", 6).alias("similarity"))


def property_similarities(spark, d):
    """Parts of one name and brand by their other properties: parts with the same ones are compared once, then their pairs
    are made. They are held in ``PIECES`` pieces by key, which meet in tasks of their own."""
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string"))
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_type").alias("type"), size.alias("size"), F.pmod(F.xxhash64("p_partkey"), F.lit(PIECES)).cast("int").alias("piece"))
    kinds = p.groupBy("p_name", "p_brand", "type", "size", "piece").agg(F.collect_list("p_partkey").alias("ids")).withColumn("kind", F.to_json(F.struct("type", "size", "piece")))
    right = kinds.select("p_name", "p_brand", "piece", *[F.col(c).alias(f"r_{c}") for c in ("type", "size", "kind", "ids")])
    left = kinds.drop("piece").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    keys, tasks = ["p_name", "p_brand", "piece"], 4 * spark.sparkContext.defaultParallelism
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys).where("kind <= r_kind")
    similar = S.field_similarity([(F.col("type"), F.col("r_type")), (F.col("size"), F.col("r_size"))])
    pairs = pairs.select("ids", "r_ids", (F.col("kind") == F.col("r_kind")).alias("same"), F.round(similar, 6).alias("similarity"))
    pairs = pairs.select(F.explode("ids").alias("x"), "r_ids", "same", "similarity").select("x", F.explode("r_ids").alias("y"), "same", "similarity").where("NOT same OR x < y")
    return pairs.select(F.least("x", "y").alias("l_id"), F.greatest("x", "y").alias("r_id"), "similarity")


def sounds_alike(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.soundex("p_name").alias("sound")).agg(F.count("*").alias("parts"), F.countDistinct("p_name").alias("names"))


def vector_correlations(spark, d):
    """Pearson and Manhattan of each vector with the one before it."""
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return e.join(b, "vec_id").select("vec_id", F.round(S.pearson(F.col("embedding"), F.col("before")), 5).alias("pearson"), F.round(S.manhattan(F.col("embedding"), F.col("before")), 4).alias("manhattan"))


QUERIES = {
    "impute_zero": impute_zero, "cleaned_records": cleaned_records, "resolve_first_seen": resolve_first_seen, "temporal_conflicts": temporal_conflicts,
    "logical_conflicts": logical_conflicts, "review_work": review_work, "best_duplicates_of_each": best_duplicates_of_each,
    "duplicate_group_quality": duplicate_group_quality, "updated_groups": updated_groups, "merged_values": merged_values, "merge_gain": merge_gain,
    "duplicate_relationships": duplicate_relationships, "property_similarities": property_similarities, "sounds_alike": sounds_alike, "vector_correlations": vector_correlations,
    "missing_profile": missing_profile, "drop_missing": drop_missing, "fill_missing": fill_missing, "impute_mean": impute_mean,
    "impute_median": impute_median, "validate_records": validate_records, "keep_first": keep_first,
    "merge_duplicate_records": merge_duplicate_records, "value_conflicts": value_conflicts, "type_conflicts": type_conflicts,
    "relationship_conflicts": relationship_conflicts, "resolve_voting": _resolved("voting"),
    "resolve_credibility": _resolved("credibility_weighted"), "resolve_highest_confidence": _resolved("highest_confidence"),
    "resolve_recent": resolve_recent, "conflict_report": conflict_report, "observation_trend": observation_trend,
    "source_disagreement": source_disagreement, "block_pairs": block_pairs, "detect_duplicates": detect_duplicates,
    "detect_duplicates_bigram": detect_duplicates_bigram, "detect_duplicates_jaro_winkler": detect_duplicates_jaro_winkler,
    "detect_incremental": detect_incremental, "duplicate_groups": duplicate_groups, "merged_entities": merged_entities,
    "merged_relationships": merged_relationships,
}

_GAPPY = """WITH g AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 11 = 0 THEN 'N/A' ELSE p_brand END AS p_brand, p_type,
  CASE WHEN p_size % 7 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"""
_OBS = """WITH o AS (
  SELECT p_name AS id, 'p_type' AS property, p_type AS value, p_brand AS source, (p_partkey % 10 + 1) / 10.0::DOUBLE AS confidence, p_type AS t, NULL::DOUBLE AS num FROM part
  UNION ALL SELECT p_name, 'p_size', p_size::VARCHAR, p_brand, (p_partkey % 10 + 1) / 10.0::DOUBLE, NULL, p_size::DOUBLE FROM part
  UNION ALL SELECT p_name, 'p_retailprice', p_retailprice::VARCHAR, p_brand, (p_partkey % 10 + 1) / 10.0::DOUBLE, NULL, p_retailprice FROM part)"""
_CONFLICTS = _OBS + """, c AS (SELECT id, property, count(*) AS n, count(DISTINCT value) AS distinct_values, count(DISTINCT source) AS sources,
  least(1.0, avg(confidence) * (1 + count(DISTINCT value) / count(*)::DOUBLE)) AS confidence,
  CASE WHEN count(num) = count(*) AND max(num) - min(num) > 1000 THEN 'high' ELSE 'medium' END AS severity
  FROM o GROUP BY id, property HAVING count(DISTINCT value) > 1)"""
_NAMES = """WITH RECURSIVE n AS (SELECT min(p_partkey) AS id, p_brand AS type, p_name AS name, max(p_size) AS size FROM part GROUP BY p_brand, p_name),
k AS (SELECT DISTINCT id, type, left(w, 4) AS key FROM (SELECT id, type, unnest(regexp_split_to_array(lower(trim(name)), '[^a-z0-9]+')) AS w FROM n) WHERE length(w) > 2),
b AS (SELECT DISTINCT x.id AS l_id, y.id AS r_id FROM k x JOIN k y USING (type, key) WHERE x.id <> y.id),
f AS (SELECT b.*, l.name AS a, r.name AS z FROM b JOIN n l ON l.id = l_id JOIN n r ON r.id = r_id
      WHERE least(length(l.name), length(r.name)) >= 0.3 * greatest(length(l.name), length(r.name))),
s AS (SELECT *, 1 - levenshtein(lower(a), lower(z)) / greatest(length(a), length(z))::DOUBLE AS sim FROM f)"""
_GROUPS = _NAMES + """, e AS (SELECT l_id, r_id FROM s WHERE sim >= 0.8),
r AS (SELECT l_id AS id, l_id AS other FROM e UNION SELECT r.id, e.r_id FROM r JOIN e ON r.other = e.l_id),
m AS (SELECT id, least(id, min(other)) AS "group" FROM r GROUP BY id)"""
_RESOLVE = """, v AS (SELECT id, property, value, sum({w}) AS w FROM {o} GROUP BY id, property, value),
r AS (SELECT id, property, value, w / sum(w) OVER (PARTITION BY id, property) AS confidence, row_number() OVER (PARTITION BY id, property ORDER BY round(w, 9) DESC, value) AS k FROM v)
"""

_ORDER_OBS = "WITH o AS (SELECT o_custkey AS id, 'o_orderstatus' AS property, o_orderstatus AS value, o_orderdate AS ts FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority, o_orderdate FROM orders)"
_KIND = "CASE WHEN p_size < 20 THEN 'Person' WHEN p_size < 35 THEN 'Organization' ELSE 'Location' END"
_CAND = ", c AS (SELECT l_id, r_id, sim FROM s WHERE sim >= 0.8 AND l_id < r_id)"
ORACLE_SQL = {
    "impute_zero": _GAPPY + " SELECT p_partkey, coalesce(p_size, 0)::DOUBLE AS p_size FROM g",
    "cleaned_records": "SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2",
    "resolve_first_seen": _ORDER_OBS + " SELECT id, property, value, 0.7::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY ts, value) AS k FROM o) WHERE k = 1",
    "temporal_conflicts": "SELECT o_custkey AS id, count(*) AS n, string_agg(DISTINCT strftime(o_orderdate, '%Y'), ',' ORDER BY strftime(o_orderdate, '%Y')) AS years, 'medium' AS severity FROM orders GROUP BY 1 HAVING count(DISTINCT strftime(o_orderdate, '%Y')) > 1",
    "logical_conflicts": f"WITH k AS (SELECT DISTINCT p_name AS id, {_KIND} AS type FROM part) SELECT a.id, a.type AS first, b.type AS second FROM k a JOIN k b ON a.id = b.id WHERE (a.type, b.type) IN (('Person', 'Organization'), ('Person', 'Location'), ('Organization', 'Location'))",
    "review_work": _OBS + """, c AS (SELECT id, property, list_sort(list_distinct(list(value))) AS vs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CASE WHEN count(num) = count(*) AND max(num) - min(num) > 1000 THEN 1 ELSE 2 END AS priority FROM o GROUP BY id, property HAVING count(DISTINCT value) > 1)
  SELECT id, property, 'Which value of ' || property || ' holds for ' || id || ': ' || array_to_string(vs, ' | ') || '?' AS question, sources, priority FROM c""",
    "best_duplicates_of_each": _NAMES + ", c AS (SELECT l_id, r_id, sim FROM s WHERE sim >= 0.7 AND l_id < r_id), u AS (SELECT *, l_id AS e FROM c UNION ALL SELECT *, r_id FROM c) SELECT DISTINCT l_id, r_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY sim DESC, l_id, r_id) AS k FROM u) WHERE k = 1",
    "duplicate_group_quality": _GROUPS + _CAND + """, q AS (SELECT m."group" AS g, avg(sim) AS a FROM c JOIN m ON m.id = c.l_id GROUP BY 1), z AS (SELECT "group" AS g, count(*) AS size FROM m GROUP BY 1)
  SELECT g AS "group", size, round(a, 6) AS mean_similarity, round(a * (0.8::DOUBLE + 0.2::DOUBLE * least(1.0::DOUBLE, size / 5.0::DOUBLE)), 6) AS confidence, 'high' AS quality FROM q JOIN z USING (g)""",
    "updated_groups": _GROUPS + " SELECT id, \"group\" FROM m",
    "merged_values": _GROUPS + """, j AS (SELECT n.*, coalesce(m."group", n.id) AS g FROM n LEFT JOIN m USING (id))
  SELECT g AS id, array_to_string(list_sort(list_distinct(list(type))), '|') AS type, array_to_string(list_sort(list_distinct(list(name))), '|') AS name, array_to_string(list_sort(list_distinct(list(size))), '|') AS size, count(*) AS merged FROM j GROUP BY g""",
    "merge_gain": _GROUPS + """ SELECT (SELECT count(*) FROM n) AS rows_before, 1.0::DOUBLE AS filled_before, (SELECT count(DISTINCT coalesce(m."group", n.id)) FROM n LEFT JOIN m USING (id)) AS rows_after, 1.0::DOUBLE AS filled_after""",
    "duplicate_relationships": """WITH t AS (SELECT p_partkey AS id, p_brand AS s, lower(p_type) AS p, lower(p_name) AS o FROM part), f AS (SELECT s, p, o, min(id) AS id FROM t GROUP BY ALL)
  SELECT f.id AS l_id, t.id AS r_id, 1.0::DOUBLE AS similarity FROM f JOIN t USING (s, p, o) WHERE f.id < t.id
  UNION ALL SELECT * FROM (SELECT a.id AS l_id, b.id AS r_id, round(0.6::DOUBLE + 0.4::DOUBLE * (1 - levenshtein(a.o, b.o) / greatest(length(a.o), length(b.o))::DOUBLE), 6) AS similarity FROM f a JOIN f b USING (s, p) WHERE a.id < b.id) WHERE similarity >= 0.8""",
    "property_similarities": """WITH p AS (SELECT p_partkey AS id, p_name, p_brand, lower(p_type) AS t, CASE WHEN p_size % 7 <> 0 THEN p_size::VARCHAR END AS z FROM part),
  x AS (SELECT a.id AS l_id, b.id AS r_id, CASE WHEN a.t = b.t THEN 1.0::DOUBLE ELSE 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))::DOUBLE END AS u, CASE WHEN a.z IS NULL OR b.z IS NULL THEN 0.5::DOUBLE WHEN a.z = b.z THEN 1.0 ELSE 1 - levenshtein(a.z, b.z) / greatest(length(a.z), length(b.z))::DOUBLE END AS v FROM p a JOIN p b USING (p_name, p_brand) WHERE a.id < b.id)
  SELECT l_id, r_id, round((u + v) / 2, 6) AS similarity FROM x""",
    "vector_correlations": """WITH j AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1),
  c AS (SELECT vec_id, x, y, list_transform(x, lambda v: v - list_avg(x)) AS cx, list_transform(y, lambda v: v - list_avg(y)) AS cy FROM j)
  SELECT vec_id, round(list_cosine_similarity(cx, cy), 5) AS pearson, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 4) AS manhattan FROM c""",
    "missing_profile": _GAPPY + ", t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce(sum(CASE WHEN {c} IS NULL OR {c}::VARCHAR IN ('', 'N/A', 'null', 'NULL') THEN 1 ELSE 0 END), 0)::BIGINT AS missing FROM g" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + ") SELECT field, missing, round(100.0 * missing / (SELECT count(*) FROM g), 6)::DOUBLE AS percent FROM t",
    "drop_missing": _GAPPY + " SELECT p_partkey, p_size FROM g WHERE p_size IS NOT NULL AND p_brand <> 'N/A'",
    "fill_missing": _GAPPY + " SELECT p_partkey, CASE WHEN p_brand = 'N/A' THEN 'unknown' ELSE p_brand END AS p_brand, coalesce(p_size, 0)::INT AS p_size FROM g",
    "impute_mean": _GAPPY + " SELECT p_partkey, round(coalesce(p_size, (SELECT avg(p_size) FROM g)), 6)::DOUBLE AS p_size FROM g",
    "impute_median": _GAPPY + ", s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM g WHERE p_size IS NOT NULL) SELECT p_partkey, coalesce(p_size, (SELECT p_size FROM s WHERE i = n // 2))::DOUBLE AS p_size FROM g",
    "validate_records": _GAPPY + """, e AS (SELECT p_partkey, concat_ws('; ', CASE WHEN p_size IS NULL THEN 'p_size: missing' END, CASE WHEN p_size < 5 THEN 'p_size: too small' END,
  CASE WHEN p_brand <> 'N/A' AND NOT regexp_matches(p_brand, '^Brand#\\d+$') THEN 'p_brand: wrong form' END, CASE WHEN p_brand <> 'N/A' AND length(p_brand) > 7 THEN 'p_brand: too long' END,
  CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO') THEN 'p_type: not a choice' END) AS errors FROM g) SELECT * FROM e WHERE errors <> ''""",
    "keep_first": "SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand",
    "merge_duplicate_records": _GAPPY + " SELECT p_name, p_type, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) FILTER (p_size IS NOT NULL) AS p_size FROM g GROUP BY p_name, p_type",
    "value_conflicts": _CONFLICTS + " SELECT id, property, n, distinct_values, sources, round(confidence, 6) AS confidence, severity FROM c",
    "type_conflicts": "SELECT p_name AS id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1",
    "relationship_conflicts": "SELECT l_suppkey AS source, l_partkey AS target, concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END) AS differing FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1",
    "resolve_voting": _OBS + _RESOLVE.format(w="1", o="o") + "SELECT id, property, value, round(confidence, 6) AS confidence FROM r WHERE k = 1",
    "resolve_credibility": _OBS + ", b AS (SELECT p_brand AS source, avg(p_size) / 50 AS c FROM part GROUP BY p_brand), w AS (SELECT o.*, confidence * c AS x FROM o JOIN b USING (source))" + _RESOLVE.format(w="x", o="w") + "SELECT id, property, value, round(confidence, 6) AS confidence FROM r WHERE k = 1",
    "resolve_highest_confidence": _OBS + " SELECT id, property, value, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY confidence DESC, value) AS k FROM o) WHERE k = 1",
    "resolve_recent": """WITH o AS (SELECT o_custkey AS id, 'o_orderstatus' AS property, o_orderstatus AS value, o_orderdate AS ts FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority, o_orderdate FROM orders)
  SELECT id, property, value, 0.8::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY ts DESC, value) AS k FROM o) WHERE k = 1""",
    "conflict_report": _CONFLICTS + " SELECT property, severity, count(*) AS conflicts FROM c GROUP BY GROUPING SETS ((property, severity), (property), (severity), ())",
    "observation_trend": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, 2 * count(*) AS n FROM orders GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY month) AS b FROM m)
  SELECT month, n, CASE WHEN b IS NULL THEN 'first' WHEN n > 1.1 * b THEN 'rising' WHEN n < 0.9 * b THEN 'falling' ELSE 'stable' END AS direction FROM l""",
    "source_disagreement": _OBS + _RESOLVE.format(w="1", o="o") + ", d AS (SELECT o.source, count(*) AS observations, sum((o.value <> r.value)::INT)::BIGINT AS disagreements FROM o JOIN r ON o.id = r.id AND o.property = r.property AND k = 1 GROUP BY o.source) SELECT *, round(1 - disagreements / observations::DOUBLE, 6) AS credibility FROM d",
    "block_pairs": _NAMES + " SELECT l_id, r_id FROM b WHERE l_id < r_id",
    "detect_duplicates": _NAMES + " SELECT l_id, r_id, round(sim, 6) AS similarity, round(least(1.0, sim + 0.05 + CASE WHEN lower(a) = lower(z) THEN 0.1 ELSE 0 END), 6) AS confidence FROM s WHERE sim >= 0.7 AND l_id < r_id",
    "detect_duplicates_bigram": _NAMES + """, g AS (SELECT *, list_distinct([lower(a)[i:i+1] FOR i IN range(1, length(a))]) AS x, list_distinct([lower(z)[i:i+1] FOR i IN range(1, length(z))]) AS y FROM f),
  j AS (SELECT l_id, r_id, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE AS sim FROM g) SELECT l_id, r_id, round(sim, 6) AS similarity FROM j WHERE sim >= 0.6 AND l_id < r_id""",
    "detect_duplicates_jaro_winkler": _NAMES + ", z AS (SELECT l_id, r_id, lower(a) AS a, lower(z) AS z, jaro_similarity(lower(a), lower(z)) AS j FROM f), w AS (SELECT *, j + 0.1::DOUBLE * (1 - j) * (CASE WHEN a[1:4] = z[1:4] THEN 4 WHEN a[1:3] = z[1:3] THEN 3 WHEN a[1:2] = z[1:2] THEN 2 WHEN a[1] = z[1] THEN 1 ELSE 0 END) AS sim FROM z) SELECT l_id, r_id, round(sim, 6) AS similarity FROM w WHERE sim >= 0.9 AND l_id < r_id",
    "detect_incremental": _NAMES + ", z AS (SELECT l.id AS l_id, r.id AS r_id, 1 - levenshtein(lower(l.name), lower(r.name)) / greatest(length(l.name), length(r.name))::DOUBLE AS sim FROM n l JOIN n r USING (type) WHERE l.id % 10 = 3 AND r.id % 10 <> 3) SELECT l_id, r_id, round(sim, 6) AS similarity FROM z WHERE sim >= 0.7",
    "duplicate_groups": _GROUPS + " SELECT id, \"group\" FROM m",
    "merged_entities": _GROUPS + """, j AS (SELECT n.*, coalesce(m."group", n.id) AS g FROM n LEFT JOIN m USING (id))
  SELECT min(id) AS id, arg_min(type, id) AS type, arg_min(name, id) AS name, arg_min(size, id) AS size, count(*) AS merged FROM j GROUP BY g""",
    "merged_relationships": """SELECT user_id::VARCHAR AS subject, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS predicate, json_extract_string(props, '$.k') AS object, min(event_id) AS id, count(*) AS merged
  FROM events GROUP BY 1, 2, 3""",
}
