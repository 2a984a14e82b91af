"""Queries of reasoning, retrieval, policies, versions, chunking and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import reasoning as R
from loomgraph.operators import retrieval as V
from loomgraph.operators import text as X
from loomgraph.plans.tables import SQL, places, relationships, table

S, P, N, X_, Y, Z = R.variables("S P N X Y Z")
LOCATED = [
    (R.Atom("located", (X_, Y)), [R.Atom("in", (X_, Y))]),
    (R.Atom("located", (X_, Z)), [R.Atom("located", (X_, Y)), R.Atom("in", (Y, Z))]),
]


def _facts(df):
    return df.select(F.col("source").alias("arg0"), F.col("target").alias("arg1"))


def datalog_closure(spark, d):
    found = R.fixpoint(LOCATED, {"in": _facts(places(spark, d))})["located"]
    return found.select(F.col("arg0").alias("x"), F.col("arg1").alias("y"))


def datalog_query(spark, d):
    facts = {"in": _facts(places(spark, d)), "supplies": _facts(relationships(spark, d).where("type = 'supplies'"))}
    return R.query([R.Atom("supplies", (S, P)), R.Atom("in", (S, N)), R.Atom("in", (N, "r:1"))], facts)


def _asked(spark, d):
    """The queries of a search: vectors whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


def knn_filtered(spark, d):
    found = V.knn(table(spark, d, "embeddings"), _asked(spark, d), 10, where=V.metadata_filter([("label", "in", [1, 2, 3]), ("vec_id", "gt", 10)]))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_l2(spark, d):
    return V.knn(table(spark, d, "embeddings"), _asked(spark, d), 10, "l2").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def knn_l1(spark, d):
    return V.knn(table(spark, d, "embeddings"), _asked(spark, d), 5, "l1").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def rank_fusion(spark, d):
    e, q = table(spark, d, "embeddings"), _asked(spark, d)
    fused = V.reciprocal_rank_fusion([V.knn(e, q, 20), V.knn(e, q, 20, "inner_product"), V.knn(e, q, 20, "l2")], ["query_id", "vec_id"])
    return fused.select("query_id", "vec_id", F.round("fused", 9).alias("fused"))


def score_fusion(spark, d):
    e, q = table(spark, d, "embeddings"), _asked(spark, d)
    fused = V.weighted_fusion([(0.7, V.knn(e, q, 20)), (0.3, V.knn(e, q, 20, "l2"))], ["query_id", "vec_id"])
    return fused.select("query_id", "vec_id", F.round("fused", 6).alias("fused"))


def mean_vectors(spark, d):
    return V.mean_pool(table(spark, d, "embeddings"), ["label"]).select("label", "pos", F.round("value", 5).alias("value"))


def latest_decisions(spark, d):
    o = table(spark, d, "orders")
    return V.latest_version(o, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


def policy_compliance(spark, d):
    rules = {"max_o_totalprice": 300000.0, "min_o_totalprice": 1000.0, "allowed_o_orderstatus": ["F", "O"], "required_o_orderdate": True}
    bad = V.policy_violations(table(spark, d, "orders"), rules).where(F.size("violations") > 0)
    return bad.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("orders"))


def snapshot_diff(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    after = p.where("p_partkey % 13 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 17 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return V.snapshot_diff(p.where("p_partkey % 19 <> 0"), after, "p_partkey").select("p_partkey", "change", F.array_join("fields", ",").alias("fields"))


def chunk_characters(spark, d):
    chunks = X.chunk_characters(table(spark, d, "documents").select("doc_id", "text"), "text", 500, 100)
    return chunks.select("doc_id", "chunk", "start", F.md5("chunk_text").alias("digest"))


def chunk_sentences(spark, d):
    chunks = X.chunk_sentences(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", 300)
    return chunks.groupBy("conv_id", "turn").agg(F.count("*").alias("chunks"), F.max(F.length("chunk_text")).cast("long").alias("longest"))


def chunk_words(spark, d):
    return X.chunk_words(table(spark, d, "documents").select("doc_id", "text"), "text", 50, 10).groupBy("doc_id").agg(F.count("*").alias("chunks"))


def chunk_paragraphs(spark, d):
    return X.chunk_paragraphs(table(spark, d, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("chunks"))


def html_text(spark, d):
    text = X.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), text.contains("<").alias("has_tag"))


def entity_mentions(spark, d):
    found = X.extract_entities(table(spark, d, "documents").select("doc_id", "text"), "text")
    return found.groupBy("label", "entity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (datalog_closure, datalog_query, knn_filtered, knn_l2, knn_l1, rank_fusion, score_fusion, mean_vectors, latest_decisions, policy_compliance, snapshot_diff, chunk_characters, chunk_sentences, chunk_words, chunk_paragraphs, html_text, entity_mentions)}

_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS cosine, list_inner_product(embedding::DOUBLE[], q) AS ip, 1 / (1 + list_distance(embedding::DOUBLE[], q)) AS l2, 1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: abs(x[1] - x[2])))) AS l1 FROM embeddings, q)"
_RANK = "(SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, vec_id) AS rank, {0} AS score FROM s QUALIFY rank <= {1})"
ORACLE_SQL = {
    "datalog_closure": f"WITH RECURSIVE {SQL}, c AS (SELECT source AS x, target AS y FROM places UNION SELECT c.x, p.target FROM c JOIN places p ON c.y = p.source) SELECT x, y FROM c",
    "datalog_query": f"WITH {SQL} SELECT DISTINCT s.source AS \"S\", s.target AS \"P\", i.target AS \"N\" FROM rels s JOIN places i ON s.source = i.source JOIN places r ON i.target = r.source WHERE s.type = 'supplies' AND r.target = 'r:1'",
    "knn_filtered": f"WITH {_Q} SELECT query_id, vec_id, round(cosine, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s WHERE label IN (1, 2, 3) AND vec_id > 10 QUALIFY rank <= 10",
    "knn_l2": f"WITH {_Q} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM {_RANK.format('l2', 10)}",
    "knn_l1": f"WITH {_Q} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM {_RANK.format('l1', 5)}",
    "rank_fusion": f"WITH {_Q} SELECT query_id, vec_id, round(sum(1 / (60 + rank)), 9) AS fused FROM (SELECT * FROM {_RANK.format('cosine', 20)} UNION ALL SELECT * FROM {_RANK.format('ip', 20)} UNION ALL SELECT * FROM {_RANK.format('l2', 20)}) GROUP BY query_id, vec_id",
    "score_fusion": f"WITH {_Q} SELECT query_id, vec_id, round(sum(z), 6) AS fused FROM (SELECT query_id, vec_id, 0.7::DOUBLE * score AS z FROM {_RANK.format('cosine', 20)} UNION ALL SELECT query_id, vec_id, 0.3::DOUBLE * score FROM {_RANK.format('l2', 20)}) GROUP BY query_id, vec_id",
    "mean_vectors": "SELECT label, (pos - 1)::INT AS pos, round(avg(x::DOUBLE), 5) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos",
    "latest_decisions": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "policy_compliance": "WITH v AS (SELECT concat_ws(',', CASE WHEN o_totalprice > 300000 THEN 'max_o_totalprice' END, CASE WHEN o_totalprice < 1000 THEN 'min_o_totalprice' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'allowed_o_orderstatus' END) AS violations FROM orders) SELECT violations, count(*) AS orders FROM v WHERE violations <> '' GROUP BY violations",
    "snapshot_diff": """WITH b AS (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 19 <> 0), a AS (SELECT p_partkey AS k, p_size + (p_partkey % 17 = 0)::INT AS p_size FROM part WHERE p_partkey % 13 <> 0)
  SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'p_size' ELSE '' END AS fields
  FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p_size <> b.p_size""",
    "chunk_characters": """WITH c AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > 0 THEN ceil(greatest(length(text) - 500, 0) / 400.0)::INT + 1 ELSE 0 END)) AS chunk FROM documents)
  SELECT doc_id, chunk::INT AS chunk, (chunk * 400)::INT AS start, md5(text[chunk * 400 + 1:chunk * 400 + 500]) AS digest FROM c""",
    "chunk_sentences": r"""WITH p AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> '') AS parts FROM conversations),
  k AS (SELECT conv_id, turn, string_split(list_reduce(parts, lambda a, p: CASE WHEN length(string_split(a, chr(31))[-1]) + 1 + length(p) <= 300 THEN a || ' ' || p ELSE a || chr(31) || p END), chr(31)) AS ch FROM p WHERE len(parts) > 0)
  SELECT conv_id, turn, len(ch) AS chunks, list_max(list_transform(ch, lambda c: length(c))) AS longest FROM k""",
    "chunk_paragraphs": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents),
  k AS (SELECT doc_id, string_split(list_reduce(parts, lambda a, p: CASE WHEN length(string_split(a, chr(31))[-1]) + 2 + length(p) <= 2000 THEN a || chr(10) || chr(10) || p ELSE a || chr(31) || p END), chr(31)) AS ch FROM p WHERE len(parts) > 0)
  SELECT doc_id, len(ch) AS chunks FROM k""",
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
  b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM a),
  c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM b)
  SELECT page_id, length(t) AS n_chars, contains(t, '<') AS has_tag FROM c""",
    "chunk_words": r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
  SELECT doc_id, (ceil(greatest(n - 50, 0) / 40.0) + 1)::BIGINT AS chunks FROM w WHERE n > 0""",
    "entity_mentions": "WITH e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest(regexp_extract_all(coalesce(text, ''), '{p}')) AS entity FROM documents" for label, p in X.PATTERNS.items()) + ") SELECT label, entity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY label, entity",
}
