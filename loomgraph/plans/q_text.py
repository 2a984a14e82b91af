"""Queries of normalisation, chunking, extraction, search, memory and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import normalize as N
from loomgraph.operators import search as H
from loomgraph.operators import text as X
from loomgraph.plans.tables import SQL, entities, relationships, table
from loomgraph.runtime import prepare

SEARCHES = ("Blue Widget", "customer 000000017", "supplier", "wid sma", "nation_7", "zzz")


def _cycle(key: str, *values):
    """One of some columns or literals, by a key."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def unicode_forms(spark, d):
    docs = table(prepare(spark), d, "documents")
    return docs.select("doc_id", F.md5(N.normalize_unicode(F.col("text"))).alias("nfc"), (F.length(N.normalize_unicode(F.col("text"), "NFD")) >= F.length("text")).alias("longer"), F.md5(N.strip_diacritics("text")).alias("plain"))


def normalized_texts(spark, d):
    return table(prepare(spark), d, "documents").select("doc_id", F.md5(N.normalize_text(F.col("text"), case="lower")).alias("digest"))


def entity_names(spark, d):
    """Part names in small letters, capitals or both, behind titles and before company forms."""
    given = F.concat(_cycle("p_partkey", "Dr. ", "mr. ", "", "Prof. Dr. ", " "), _cycle("p_partkey", F.col("p_name"), F.upper("p_name"), F.initcap("p_name")), _cycle("p_partkey", " Inc.", " CORP.", "", ", Inc."))
    return table(spark, d, "part").select("p_partkey", given.alias("given")).select("p_partkey", "given", N.entity_name(F.col("given")).alias("name"))


def resolved_aliases(spark, d):
    nations = table(spark, d, "nation")
    aliases = nations.select(F.concat(F.lit(" "), F.lower("n_name")).alias("alias"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("canonical"))
    names = nations.select("n_name").unionByName(table(spark, d, "region").select(F.col("r_name").alias("n_name")))
    return N.resolve_aliases(names, "n_name", aliases)


def quantities(spark, d):
    given = F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".5"), _cycle("p_partkey", " km", " lb", "ml", " parsecs"))
    return table(spark, d, "part").select("p_partkey", N.quantity(given).alias("q")).select("p_partkey", "q.value", "q.unit", "q.dimension", F.round("q.base", 6).alias("base"))


def converted_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(N.convert(F.col("p_size"), "in", "cm"), 6).alias("cm"))


def money_amounts(spark, d):
    price = F.round("o_totalprice", 2)
    given = _cycle("o_orderkey", F.concat(F.lit("$"), F.format_number(price, 2)), F.concat(F.lit("EUR "), F.floor(price).cast("string"), F.lit("k")), F.concat(F.lit("£"), F.format_number(price, 2)), F.lit("none"))
    return table(spark, d, "orders").select("o_orderkey", N.money(given).alias("m")).select("o_orderkey", F.round("m.amount", 2).alias("amount"), "m.currency")


def relative_times(spark, d):
    unit = _cycle("p_partkey", "second", "minute", "hour", "day", "week", "month", "year", "eon")
    given = F.concat(F.col("p_size").cast("string"), F.lit(" "), unit, F.lit("s "), _cycle("p_size", "ago", "from now"))
    found = N.relative_time(given, F.lit("1998-06-01 12:00:00").cast("timestamp_ntz"))
    return table(spark, d, "part").select("p_partkey", given.alias("given"), F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("moment"))


def times_in_utc(spark, d):
    """Noon of each order's day in New York, summer and winter."""
    noon = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOUR")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(N.to_utc(noon, "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def file_names(spark, d):
    given = F.concat(_cycle("p_partkey", " ..", ""), "p_brand", F.lit("/"), "p_name", F.lit(": "), "p_type", _cycle("p_partkey", "?.txt", "*. "))
    return table(spark, d, "part").select("p_partkey", N.safe_filename(given).alias("name"))


def naming_conventions(spark, d):
    """Names of one, two or three words in plural, and of properties that have their form already."""
    plural = F.concat("p_name", F.lit("-"), F.lower("p_type"), F.lit("s"))
    camel = F.concat(F.element_at(F.split("p_name", " "), 1), F.initcap("p_type"))
    return table(spark, d, "part").select("p_partkey", N.class_name(plural).alias("class_name"), N.property_name(F.col("p_name")).alias("property_name"), N.property_name(camel).alias("kept"))


def parsed_numbers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice"), 2).alias("v"))
    return o.select("o_orderkey", F.round(X.parse_number(F.concat(F.lit("$"), F.format_number("v", 2))), 2).alias("value"))


def table_checksums(spark, d):
    """One checksum of a table in two layouts."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return N.table_checksum(p.repartition(3)).join(N.table_checksum(p.orderBy(F.desc("p_partkey"))).withColumnRenamed("checksum", "again"), "rows").select("rows", "checksum", "again")


def chunk_tokens(spark, d):
    n = F.size(F.filter(F.split("chunk_text", r"\s+"), lambda w: w != ""))
    return X.chunk_tokens(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", 40).groupBy("conv_id", "turn").agg(F.count("*").alias("chunks"), F.sum(n).alias("words"))


def chunk_recursively(spark, d):
    """Chunks of each document, and whether they cover it."""
    c = X.chunk_recursively(table(spark, d, "documents").select("doc_id", "text"), "text", 500)
    return c.groupBy("doc_id").agg(F.sum(F.length("chunk_text")).alias("characters"), F.max(F.col("end")).cast("long").alias("last"), (F.max(F.length("chunk_text")) <= 500).alias("within"))


def chunk_sliding(spark, d):
    c = X.chunk_sliding(table(spark, d, "documents").select("doc_id", "text"), "text", 500, 100)
    return c.groupBy("doc_id").agg(F.min("start").cast("long").alias("first"), F.max("end").cast("long").alias("last"), (F.max(F.length("chunk_text")) <= 500).alias("within"))


def chunk_structure(spark, d):
    """Part names as documents of headings, lists and code."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("# "), "p_name", F.lit("\nsold as\n"), "p_type", F.lit("\n\n- "), "p_brand", F.lit("\n- size "), F.col("p_size").cast("string"), F.lit("\n```\nx = 1\n\n# no heading\n```\n1. end"))
    return X.chunk_structure(p.select("p_partkey", text.alias("text")), "text").groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "kind", F.length("chunk_text").alias("n")))), lambda x: F.concat_ws(":", x["kind"], x["n"])), ",").alias("blocks"))


def chunk_hierarchy(spark, d):
    c = X.chunk_hierarchy(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return c.groupBy("doc_id", "level").agg(F.sum(F.length("chunk_text")).alias("characters"), F.count("parent_id").alias("parents") == F.count("*")).toDF("doc_id", "level", "characters", "have_parents")


def _sentences(spark, d):
    """What the tables say of suppliers, in words."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("Firm"), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", "n_name", "r_name", F.concat(name, F.lit(" is located in "), F.initcap("n_name"), F.lit(". In 1997 "), name, F.lit(" acquired Works"), F.col("s_nationkey").cast("string"), F.lit(". They launched it.")).alias("text"))


def relations_in_text(spark, d):
    return X.extract_relations(_sentences(spark, d), "text").select("s_suppkey", "relation", "subject", "object", "confidence")


def triples_in_text(spark, d):
    return X.triples(X.extract_relations(_sentences(spark, d), "text"), 0.5)


def events_in_text(spark, d):
    return X.detect_events(_sentences(spark, d), "text").select("s_suppkey", "kind", "trigger", "date")


def keyword_scores(spark, d):
    q = F.lit("blue wid SMALL")
    e = entities(spark, d).select("id", F.round(H.keyword_score(q, F.col("name")), 6).alias("score"), F.round(H.entity_match_score(q, F.col("name")), 6).alias("match"))
    return e.where("score > 0")


def indexed_search(spark, d):
    found = H.search_names(H.name_index(entities(spark, d)), spark.createDataFrame([(q,) for q in SEARCHES], "query string"), 5)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


def short_term_memory(spark, d):
    return H.short_term(table(spark, d, "conversations"), "conv_id", "turn", "text", 4, 60).select("conv_id", "turn")


def retained_events(spark, d):
    return H.retained(table(spark, d, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7).select("event_id")


def second_page(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return H.page(o, ["o_custkey", "o_orderkey"], (7, 1000), 25)


def triple_changes(spark, d):
    t = relationships(spark, d).select(F.col("source").alias("subject"), F.col("type").alias("predicate"), F.col("target").alias("object"), "valid_from")
    cut = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return H.triple_delta(t.where(F.col("valid_from").isNull() | (F.col("valid_from") < cut)), t.where("predicate <> 'part_of'"))


def vector_distances(spark, d):
    e = table(spark, d, "embeddings")
    return H.pairwise_distances(e, e.where("vec_id % 100 = 0"), S.euclidean).select("a", "b", F.round("distance", 5).alias("distance"))


def word_overlap(spark, d):
    """Jaccard of the words of part names and types within a brand."""
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    r = p.withColumnRenamed("p_name", "other")
    return p.join(r, "p_brand").where("p_name < other").select("p_brand", "p_name", "other", F.round(S.jaccard(S.word_set(F.col("p_name")), S.word_set(F.col("other"))), 6).alias("similarity"))


Q = unicode_forms, normalized_texts, entity_names, resolved_aliases, quantities, converted_sizes, money_amounts, relative_times, times_in_utc, file_names, naming_conventions, parsed_numbers, table_checksums, chunk_tokens, chunk_recursively, chunk_sliding, chunk_structure, chunk_hierarchy, relations_in_text, triples_in_text, events_in_text, keyword_scores, indexed_search, short_term_memory, retained_events, second_page, triple_changes, vector_distances, word_overlap
QUERIES = {f.__name__: f for f in Q}

_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SENT = "x AS (SELECT s_suppkey, s_nationkey, 'Firm' || s_suppkey AS firm, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS land FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^a-z0-9]+')), lambda w: w <> '')"
ORACLE_SQL = {
    "unicode_forms": "SELECT doc_id, md5(nfc_normalize(text)) AS nfc, text IS NOT NULL AS longer, md5(strip_accents(text)) AS plain FROM documents",
    "normalized_texts": "SELECT doc_id, md5(trim(lower(replace(translate(" + _WS.format("nfc_normalize(text)") + """, '‘’“”–—', '''''""--'), '…', '...')))) AS digest FROM documents""",
    "entity_names": f"""SELECT p_partkey, ['Dr. ', 'mr. ', '', 'Prof. Dr. ', ' '][p_partkey % 5 + 1] || [p_name, upper(p_name), {_TITLE.format('p_name')}][p_partkey % 3 + 1] || [' Inc.', ' CORP.', '', ', Inc.'][p_partkey % 4 + 1] AS given, {_TITLE.format('p_name')} AS name FROM part""",
    "resolved_aliases": "SELECT n_name, 'n:' || n_nationkey AS canonical FROM nation UNION ALL SELECT r_name, r_name FROM region",
    "quantities": """WITH q AS (SELECT p_partkey, 1000.5::DOUBLE + p_size AS v, ['km', 'lb', 'ml', NULL][p_partkey % 4 + 1] AS unit FROM part) SELECT p_partkey, CASE WHEN unit IS NOT NULL THEN v END AS value, unit, CASE unit WHEN 'km' THEN 'length' WHEN 'lb' THEN 'weight' WHEN 'ml' THEN 'volume' END AS dimension, round(v * CASE unit WHEN 'km' THEN 1000::DOUBLE WHEN 'lb' THEN 0.45359237::DOUBLE WHEN 'ml' THEN 0.001::DOUBLE END, 6) AS base FROM q""",
    "converted_sizes": "SELECT p_partkey, round(p_size * 2.54::DOUBLE, 6) AS cm FROM part",
    "money_amounts": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN floor(round(o_totalprice, 2)) * 1000 WHEN 3 THEN NULL ELSE round(o_totalprice, 2) END AS amount, ['USD', 'EUR', 'GBP', NULL][o_orderkey % 4 + 1] AS currency FROM orders",
    "relative_times": """WITH r AS (SELECT p_partkey, p_size::INT AS n, ['second', 'minute', 'hour', 'day', 'week', 'month', 'year', 'eon'][p_partkey % 8 + 1] AS unit, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END AS sign FROM part),
  m AS (SELECT *, TIMESTAMP '1998-06-01 12:00:00' AS t, n * sign AS k FROM r)
  SELECT p_partkey, n || ' ' || unit || 's ' || CASE WHEN sign < 0 THEN 'ago' ELSE 'from now' END AS given, strftime(CASE unit WHEN 'second' THEN t + to_seconds(k) WHEN 'minute' THEN t + to_minutes(k) WHEN 'hour' THEN t + to_hours(k) WHEN 'day' THEN t + to_days(k) WHEN 'week' THEN t + to_days(7 * k) WHEN 'month' THEN t + to_months(k) WHEN 'year' THEN t + to_years(k) END, '%Y-%m-%d %H:%M:%S') AS moment FROM m""",
    "times_in_utc": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, year(o_orderdate) AS y FROM orders),
  s AS (SELECT *, make_date(y, 4, 1) + ((7 - dayofweek(make_date(y, 4, 1))) % 7)::INT AS spring, make_date(y, 10, 31) - dayofweek(make_date(y, 10, 31))::INT AS autumn FROM o)
  SELECT o_orderkey, strftime(d + INTERVAL 12 HOUR + CASE WHEN d >= spring AND d < autumn THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc FROM s""",
    "file_names": r"""SELECT p_partkey, regexp_replace(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN ' ..' ELSE '' END || p_brand || '/' || p_name || ': ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '?.txt' ELSE '*. ' END, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM part""",
    "naming_conventions": f"""SELECT p_partkey, replace({_TITLE.format('p_name')}, ' ', '') || {_TITLE.format('p_type')} AS class_name, lower(p_name[1]) || replace({_TITLE.format('p_name')}, ' ', '')[2:] AS property_name, string_split(p_name, ' ')[1] || {_TITLE.format('p_type')} AS kept FROM part""",
    "parsed_numbers": "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders",
    "table_checksums": f"""WITH h AS (SELECT sha256('{{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}}') AS h FROM part), s AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(h, {k}, 15))::BIGINT) AS s{k}" for k in (1, 16, 31, 46))} FROM h), c AS (SELECT n, sha256(concat_ws(',', n, s1, s16, s31, s46)) AS c FROM s) SELECT n AS rows, c AS checksum, c AS again FROM c""",
    "chunk_tokens": r"""WITH p AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> '') AS parts FROM conversations),
  k AS (SELECT conv_id, turn, parts, string_split(list_reduce(parts, lambda a, p: CASE WHEN len(list_filter(regexp_split_to_array(string_split(a, chr(31))[-1] || ' ' || p, '\s+'), lambda w: w <> '')) <= 40 THEN a || ' ' || p ELSE a || chr(31) || p END), chr(31)) AS ch FROM p WHERE len(parts) > 0)
  SELECT conv_id, turn, len(ch) AS chunks, list_sum(list_transform(parts, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))))::BIGINT AS words FROM k""",
    "chunk_recursively": "SELECT doc_id, length(text) AS characters, length(text) AS last, true AS within FROM documents WHERE length(text) > 0",
    "chunk_sliding": "SELECT doc_id, 0::BIGINT AS first, length(text) AS last, true AS within FROM documents WHERE length(text) > 0",
    "chunk_hierarchy": "SELECT doc_id, l::INT AS level, length(text) AS characters, l > 0 AS have_parents FROM documents, (VALUES (0), (1), (2)) v(l) WHERE length(text) > 0",
    "chunk_structure": "SELECT p_partkey, 'heading:' || (2 + length(p_name)) || ',text:' || (8 + length(p_type)) || ',list:' || (10 + length(p_brand) + length(p_size::VARCHAR)) || ',code:27,list:6' AS blocks FROM part",
    "relations_in_text": f"WITH {_SENT} SELECT s_suppkey, 'located_in' AS relation, firm AS subject, land AS object, 0.7::DOUBLE AS confidence FROM x UNION ALL SELECT s_suppkey, 'acquired', firm, 'Works' || s_nationkey, 0.7 FROM x",
    "triples_in_text": f"WITH {_SENT} SELECT firm AS subject, 'located_in' AS predicate, land AS object, 0.7::DOUBLE AS confidence FROM x UNION ALL SELECT firm, 'acquired', 'Works' || s_nationkey, 0.7 FROM x",
    "events_in_text": f"WITH {_SENT} SELECT s_suppkey, 'acquisition' AS kind, 'acquired' AS trigger, '1997' AS date FROM x UNION ALL SELECT s_suppkey, 'launch', 'launched', NULL FROM x",
    "keyword_scores": f"WITH {SQL}, q AS (SELECT id, lower(name) AS n, {_WORDS.format('name')} AS ws FROM entities), s AS (SELECT id, contains(n, 'blue')::INT + contains(n, 'wid')::INT + contains(n, 'small')::INT AS k, len(list_intersect(ws, ['blue', 'wid', 'small'])) AS m FROM q) SELECT id, round(k / 3.0::DOUBLE, 6) AS score, round((m + 1) / 3.0::DOUBLE, 6) AS match FROM s WHERE k > 0",
    "indexed_search": f"""WITH {SQL}, q AS (SELECT query, {_WORDS.format('query')} AS qs FROM (VALUES {", ".join(f"('{s}')" for s in SEARCHES)}) t(query)), e AS (SELECT id, lower(name) AS n, {_WORDS.format('name')} AS ws FROM entities),
      s AS (SELECT query, id, CASE WHEN lower(query) = n THEN 1.0::DOUBLE ELSE list_sum(list_transform(qs, lambda w: CASE WHEN list_contains(ws, w) THEN 0.8::DOUBLE WHEN length(w) >= 3 AND len(list_filter(ws, lambda v: starts_with(v, w))) > 0 THEN 0.5 ELSE 0 END)) / len(qs) END AS score FROM q, e)
      SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""",
    "short_term_memory": r"""WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t) SELECT conv_id, turn FROM s WHERE k <= 4 AND total <= 60""",
    "retained_events": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13'",
    "second_page": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (7, 1000) ORDER BY 1, 2 LIMIT 25",
    "triple_changes": f"WITH {SQL} SELECT 'removed' AS change, source AS subject, type AS predicate, target AS object FROM rels WHERE type = 'part_of' UNION ALL SELECT 'added', source, type, target FROM rels WHERE valid_from >= TIMESTAMP '1997-01-01'",
    "vector_distances": "SELECT x.vec_id AS a, y.vec_id AS b, round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE x.vec_id % 100 = 0 AND y.vec_id % 100 = 0",
    "word_overlap": f"WITH p AS (SELECT DISTINCT p_brand, p_name, {_WORDS.format('p_name')} AS ws FROM part) SELECT a.p_brand, a.p_name, b.p_name AS other, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE, 6) AS similarity FROM p a JOIN p b USING (p_brand) WHERE a.p_name < b.p_name",
}
