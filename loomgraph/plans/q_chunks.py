"""Queries of chunks that keep entities, relations and subjects together."""

from __future__ import annotations

from loomgraph.operators import chunks as C
from loomgraph.plans.q_mentions import _TOKENS, _docs


def chunk_by_entities(spark, d):
    return C.chunk_by_entities(_docs(spark, d), ["doc_id"], "text", 300)


def chunk_by_relations(spark, d):
    return C.chunk_by_relations(_docs(spark, d), ["doc_id"], "text", 300)


def chunk_by_meaning(spark, d):
    """Cut at the widest distances alone."""
    return C.chunk_by_meaning(_docs(spark, d), ["doc_id"], "text", 1 << 30, 0.8)


def chunk_by_meaning_and_size(spark, d):
    return C.chunk_by_meaning(_docs(spark, d), ["doc_id"], "text", 300, 0.95)


QUERIES = {f.__name__: f for f in (chunk_by_entities, chunk_by_relations, chunk_by_meaning, chunk_by_meaning_and_size)}

#: Sentences of the documents with their places, numbered from 1, and the gaps after them.
_SENTENCES = r"""
cut AS (SELECT doc_id, regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+$', '\1') AS body FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, unnest(string_split_regex(body, '[.!?][ \t\n\x0b\f\r]+')) AS s, unnest(list_concat(regexp_extract_all(body, '[.!?][ \t\n\x0b\f\r]+'), [''])) AS g, unnest(range(1, 2 + len(regexp_extract_all(body, '[.!?][ \t\n\x0b\f\r]+')))) AS k FROM cut),
sent AS (SELECT doc_id, k, s || left(g, 1) AS s, (sum(length(s) + length(g)) OVER w - length(s) - length(g))::BIGINT AS a, (sum(length(s) + length(g)) OVER w - length(g) + least(length(g), 1))::BIGINT AS b, (sum(length(s) + length(g)) OVER w)::BIGINT AS c, lead(k) OVER w IS NULL AS ends FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY k))"""
#: Sentences that must stay together are one atom; atoms are packed one after the other.
_PACKED = """
atoms AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) AS n, min(a) AS a, max(b) AS b, bool_or(forced) AS forced FROM (SELECT *, coalesce(sum((NOT kept)::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS atom FROM marked) GROUP BY doc_id, atom),
packed AS (SELECT doc_id, n, a, b, a AS start, 0 AS chunk, forced FROM atoms WHERE n = 1
  UNION ALL SELECT x.doc_id, x.n, x.a, x.b, CASE WHEN p.forced OR x.b - p.start > {size} THEN x.a ELSE p.start END, p.chunk + (p.forced OR x.b - p.start > {size})::INT, x.forced FROM packed p JOIN atoms x ON x.doc_id = p.doc_id AND x.n = p.n + 1),
done AS (SELECT doc_id, chunk, min(start) AS start, max(b) AS end_ FROM packed GROUP BY doc_id, chunk)"""


def _around_mentions(within: int) -> str:
    near = f"OR (SELECT min(x.start) FROM m x WHERE x.doc_id = t.doc_id AND x.start >= t.c) - (SELECT max(x.end_) FROM m x WHERE x.doc_id = t.doc_id AND x.end_ <= t.b) < {within}" if within else ""
    return f"""WITH RECURSIVE {_TOKENS}, {_SENTENCES},
marked AS (SELECT *, false AS forced, NOT ends AND coalesce(EXISTS (SELECT 1 FROM m x WHERE x.doc_id = t.doc_id AND x.start < t.c AND x.end_ > t.b) {near}, false) AS kept FROM sent t), {_PACKED.format(size=300)}
SELECT doc_id, chunk, start, end_ AS "end", substr(text, start + 1, end_ - start) AS chunk_text, (SELECT count(*) FROM m WHERE m.doc_id = done.doc_id AND m.start >= done.start AND m.start < done.end_) AS held FROM done JOIN documents USING (doc_id)"""


def _by_meaning(size: int, percentile: float) -> str:
    return rf"""WITH RECURSIVE {_SENTENCES},
bags AS (SELECT *, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS w FROM sent),
dist AS (SELECT *, CASE WHEN ends THEN NULL WHEN len(w) = 0 OR len(v) = 0 THEN 1.0 ELSE round(1 - len(list_intersect(w, v)) / sqrt(len(w)::DOUBLE * len(v)), 9) END AS far FROM (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY k) AS v FROM bags)),
marked AS (SELECT *, false AS kept, coalesce(far > 0 AND far >= quantile_disc(far, {percentile}) OVER (PARTITION BY doc_id), false) AS forced FROM dist), {_PACKED.format(size=size)}
SELECT doc_id, chunk, start, end_ AS "end", substr(text, start + 1, end_ - start) AS chunk_text, 0 AS held FROM done JOIN documents USING (doc_id)"""


ORACLE_SQL = {"chunk_by_entities": _around_mentions(0), "chunk_by_relations": _around_mentions(100), "chunk_by_meaning": _by_meaning(1 << 30, 0.8), "chunk_by_meaning_and_size": _by_meaning(300, 0.95)}
