"""Queries of mentions with offsets, co-occurrence and coreference."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import mentions as M
from loomgraph.plans.tables import table
from loomgraph.runtime import dealt


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _messages(spark, d):
    """A sentence or two about each part, with all four labels and pronouns."""
    name = F.initcap("p_name")
    day = F.concat(1 + F.col("p_partkey") % 28, F.lit("/"), 1 + F.col("p_partkey") % 12, F.lit("/1997"))
    text = F.concat(name, F.lit(" Inc. sold "), F.col("p_size"), F.lit(" to Anna Berg of "), F.initcap("p_type"), F.lit(" City on "), day, F.lit(". She kept it, they "), F.repeat(F.lit("gladly "), F.col("p_size").cast("int") % 16), F.lit("agreed; his offer of "), 1900 + F.col("p_partkey") % 100, F.lit(" stands."))
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return dealt(part, "p_partkey").select("p_partkey", text.alias("text"))


def mentions_in_documents(spark, d):
    return M.find_mentions(_docs(spark, d), ["doc_id"], "text")


def cooccurrences_in_documents(spark, d):
    return M.co_occurrences(M.find_mentions(_docs(spark, d), ["doc_id"], "text"), ["doc_id"])


def mentions_in_messages(spark, d):
    return M.find_mentions(_messages(spark, d), ["p_partkey"], "text")


def cooccurrences_in_messages(spark, d):
    return M.co_occurrences(M.find_mentions(_messages(spark, d), ["p_partkey"], "text"), ["p_partkey"])


def pronouns_in_documents(spark, d):
    return M.resolve_pronouns(_docs(spark, d), ["doc_id"], "text")


def coreferences_in_messages(spark, d):
    return M.coreference_chains(_messages(spark, d), ["p_partkey"], "text")


QUERIES = {f.__name__: f for f in (mentions_in_documents, cooccurrences_in_documents, mentions_in_messages, cooccurrences_in_messages, pronouns_in_documents, coreferences_in_messages)}

#: Tokens of a text with their places; names are islands of capitalised tokens, dates runs of five tokens or one.
_TOKENS = r"""
t0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS t, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM documents),
t1 AS (SELECT doc_id, i, t, (sum(length(t)) OVER w)::BIGINT AS e, lag(t) OVER w AS g, lag(t, 2) OVER w AS p, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2, lead(t, 3) OVER w AS n3, lead(t, 4) OVER w AS n4 FROM t0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
nm AS (SELECT *, regexp_full_match(t, '[A-Z][a-z]+') AS name, regexp_full_match(coalesce(p, ''), '[A-Z][a-z]+') AND regexp_full_match(g, '[ \t\n\x0b\f\r]+') AND NOT regexp_matches(t, '^(Inc|Corp|LLC|Ltd|Company)') AS goes_on FROM t1),
isl AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM nm WHERE name),
person AS (SELECT doc_id, 'PERSON' AS label, min(e - length(t)) AS s, max(e) AS e, count(*) AS k FROM isl GROUP BY doc_id, island HAVING count(*) > 1),
dt AS (SELECT doc_id, i, e, t, regexp_full_match(t, '[0-9]{1,2}') AND n1 IN ('/', '-') AND regexp_full_match(coalesce(n2, ''), '[0-9]{1,2}') AND n3 = n3 AND n3 IN ('/', '-') AND regexp_full_match(coalesce(n4, ''), '[0-9]{2,4}') AS long, n1, n2, n3, n4 FROM t1),
dl AS (SELECT *, coalesce(lag(long, 2) OVER w, false) OR coalesce(lag(long, 4) OVER w, false) AS inside FROM dt WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
dates AS (SELECT doc_id, 'DATE' AS label, e - length(t) AS s, CASE WHEN long THEN e + 2 + length(n2) + length(n4) ELSE e END AS e FROM dl WHERE (long OR regexp_full_match(t, '[0-9]{4}')) AND NOT inside),
gpe AS (SELECT doc_id, 'GPE' AS label, CASE WHEN joined THEN e - length(t) ELSE e - length(t) - length(g) - length(p) END AS s, e FROM (SELECT *, regexp_full_match(t, '[A-Z][a-z]+(City|State|Country|Nation)') AS joined FROM t1) WHERE joined OR (t IN ('City', 'State', 'Country', 'Nation') AND regexp_full_match(g, '[ \t\n\x0b\f\r]+') AND regexp_full_match(p, '[A-Z][a-z]+'))),
m AS (SELECT d.doc_id, x.label, x.s AS start, x.e AS end_, substr(d.text, x.s::INT + 1, (x.e - x.s)::INT) AS mention FROM (SELECT doc_id, label, s, e FROM person UNION ALL SELECT * FROM dates UNION ALL SELECT * FROM gpe) x JOIN documents d USING (doc_id))"""
#: The same messages, and where each label stands in them, by the lengths of what stands before.
_MESSAGES = r"""
x AS (SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS nm, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ty, p_size::VARCHAR AS sz,
        (1 + p_partkey % 28) || '/' || (1 + p_partkey % 12) || '/1997' AS dy, repeat('gladly ', (p_size % 16)::INT) AS gl, (1900 + p_partkey % 100)::VARCHAR AS yr FROM part),
y AS (SELECT *, length(nm) + 5 AS e1, length(nm) + 5 + 6 + length(sz) + 4 AS s2, length(nm) + 5 + 6 + length(sz) + 4 + 9 + 4 AS s3 FROM x),
z AS (SELECT *, s3 + length(ty) + 5 + 4 AS s4 FROM y),
v AS (SELECT *, s4 + length(dy) + 2 AS s5 FROM z),
m AS (
  SELECT p_partkey, 'ORG' AS label, 0::BIGINT AS start, e1::BIGINT AS end_, nm || ' Inc.' AS mention FROM v
  UNION ALL SELECT p_partkey, 'PERSON', 0, length(nm), nm FROM v WHERE contains(nm, ' ')
  UNION ALL SELECT p_partkey, 'PERSON', s2, s2 + 9, 'Anna Berg' FROM v
  UNION ALL SELECT p_partkey, 'PERSON', s3, s3 + length(ty) + 5, ty || ' City' FROM v
  UNION ALL SELECT p_partkey, 'GPE', s3 + length(ty) - length(string_split(ty, ' ')[-1]), s3 + length(ty) + 5, string_split(ty, ' ')[-1] || ' City' FROM v
  UNION ALL SELECT p_partkey, 'DATE', s4, s4 + length(dy), dy FROM v
  UNION ALL SELECT p_partkey, 'DATE', s5 + 18 + length(gl) + 21, s5 + 18 + length(gl) + 25, yr FROM v),
pr AS (SELECT p_partkey, unnest(['She', 'it', 'they', 'his']) AS pronoun, unnest([s5, s5 + 9, s5 + 13, s5 + 18 + length(gl) + 8]) AS ps FROM v)"""


def _pairs(key: str) -> str:
    return f"""SELECT a.{key}, a.mention AS subject, a.start AS subject_start, b.mention AS object, b.start AS object_start, abs(a.end_ - b.start) AS distance, 'related_to' AS predicate, 0.6::DOUBLE AS confidence
  FROM m a JOIN m b ON a.{key} = b.{key} AND (a.start, a.end_, a.label, a.mention) < (b.start, b.end_, b.label, b.mention) AND abs(a.end_ - b.start) < 100"""


_RANK = "CASE label WHEN 'ORG' THEN 1 WHEN 'PERSON' THEN 2 WHEN 'GPE' THEN 3 ELSE 4 END"
_FITS = "CASE WHEN lower(pronoun) IN ('he', 'him', 'his', 'she', 'her') THEN label = 'PERSON' WHEN lower(pronoun) IN ('it', 'its') THEN label IN ('ORG', 'GPE', 'DATE') ELSE label IN ('ORG', 'GPE', 'PERSON') END"
ORACLE_SQL = {
    "mentions_in_documents": f'WITH {_TOKENS} SELECT doc_id, label, start, end_ AS "end", mention, 0.7::DOUBLE AS confidence FROM m',
    "cooccurrences_in_documents": f"WITH {_TOKENS} {_pairs('doc_id')}",
    "mentions_in_messages": f'WITH {_MESSAGES} SELECT p_partkey, label, start, end_ AS "end", mention, 0.7::DOUBLE AS confidence FROM m',
    "cooccurrences_in_messages": f"WITH {_MESSAGES} {_pairs('p_partkey')}",
    "pronouns_in_documents": f"""WITH {_TOKENS},
pr AS (SELECT doc_id, e - length(t) AS ps, e AS pe, t AS pronoun FROM t1 WHERE lower(t) IN ('he', 'him', 'his', 'she', 'her', 'it', 'its', 'they', 'them', 'their')),
c AS (SELECT pr.*, m.mention, m.label, m.start, row_number() OVER (PARTITION BY pr.doc_id, pr.ps ORDER BY CASE WHEN m.label IS NULL THEN 1 WHEN {_FITS} THEN 0 ELSE 1 END, m.end_ DESC, {_RANK}) AS k FROM pr LEFT JOIN m ON m.doc_id = pr.doc_id AND m.end_ < pr.ps)
SELECT doc_id, ps AS start, pe AS "end", pronoun, mention AS antecedent, label AS antecedent_label, start AS antecedent_start FROM c WHERE k = 1""",
    "coreferences_in_messages": f"""WITH {_MESSAGES},
c AS (SELECT pr.*, m.mention, m.label, row_number() OVER (PARTITION BY pr.p_partkey, pr.ps ORDER BY CASE WHEN {_FITS} THEN 0 ELSE 1 END, m.end_ DESC, {_RANK}) AS k FROM pr JOIN m ON m.p_partkey = pr.p_partkey AND m.end_ < pr.ps),
u AS (SELECT p_partkey, lower(mention) AS entity, label, 1 AS m, 0 AS p, start FROM m UNION ALL SELECT p_partkey, lower(mention), label, 0, 1, NULL FROM c WHERE k = 1)
SELECT p_partkey, entity, label, sum(m)::BIGINT AS mentions, sum(p)::BIGINT AS pronouns, min(start) AS first_start FROM u GROUP BY ALL""",
}
