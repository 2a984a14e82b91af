"""op2: licences in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.license_scan import POSTINGS, LOOKED_UP, STRETCH, VOTES, Template, Text, all_templates, all_texts, labels_text, scan_licenses, template_idf
from loomgraph.runtime import spread


def license_report(docs: DataFrame) -> DataFrame:
    """One row of places and labels for every document, repeated ones included; a null text has no words. labels: those of
    the phrases and of the whole texts found; texts: the latter with the word, to STRETCH, at which each starts first."""
    templates, texts = all_templates(), all_texts()
    docs = docs.select("doc_id", "text")
    found = scan_licenses(docs, templates, texts, template_idf(docs, [*templates, *texts]))
    named = F.array_compact(F.array(*[F.when(F.size(F.get("texts", F.lit(k))) > 0, F.lit(t.label)) for k, t in enumerate(texts)]))
    stands = F.array_compact(F.array(*[F.when(F.size(F.get("texts", F.lit(k))) > 0, F.concat(F.lit(f"{t.label}@"), ((F.array_min(F.get("texts", F.lit(k))) - 1) * STRETCH).cast("string"))) for k, t in enumerate(texts)]))
    n_base = sum(t.base for t in templates)
    length = F.array(*[F.lit(len(t.words)) for t in templates])
    base = F.slice("places", 1, n_base)
    last = F.zip_with(base, F.slice(length, 1, n_base), lambda p, n: F.array_max(p) + n - 1)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda acc, p: acc + F.size(p)).alias("n_base"),
        F.array_min(F.flatten(base)).cast("long").alias("first_word"),
        F.array_max(F.flatten(base)).cast("long").alias("last_word"),
        labels_text(F.col("places"), [t.label if t.base else None for t in templates]).alias("base_labels"),
        labels_text(F.col("places"), [t.label for t in templates], named).alias("labels"),
        "score",
        F.array_max(last).cast("long").alias("last_end"),
        F.array_join(stands, ",").alias("texts"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every row of documents."""
    return license_report(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle(templates: list[Template], texts: list[Text]) -> str:
    """Every phrase tried at every place; the votes of whole texts counted by grouping, one row a vote."""
    def places(t: Template) -> str:
        return f"[i FOR i IN range(0, len(ws) - {len(t.words) - 1}) IF " + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(t.words)) + "]"

    vocabulary = sorted({w for t in [*templates, *texts] for w in t.words})
    base = [k for k, t in enumerate(templates) if t.base]
    label = lambda only, more="": "array_to_string(list_sort(list_distinct(list_filter(list_concat([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(templates) if t.label and (t.base or not only)) + f"], {more or '[]'}), lambda x: x IS NOT NULL))), ',')"
    weight = lambda t: "(" + " + ".join(f"(SELECT idf FROM idf WHERE word = '{w}')" for w in t.words) + ")"
    every = "list_concat(" * (len(base) - 1) + f"p{base[0]}" + "".join(f", p{k})" for k in base[1:])
    ends = "greatest(" + ", ".join(f"list_max(p{k}) + {len(templates[k].words) - 1}" for k in base) + ")"
    first = ", ".join(f"({t}, '{w}', {text.words.index(w)})" for t, text in enumerate(texts) for w in sorted(set(text.words)))
    there = lambda k, t: f"len(list_filter(p{k}, lambda p: p >= (b - 1) * {STRETCH} AND p < (b + 1) * {STRETCH} + {len(t.words)})) > 0"
    stands = " ".join(f"WHEN t = {k} THEN " + " AND ".join(there(m, t) for m in t.mandatory) for k, t in enumerate(texts))
    mandatory = " + ".join(f"len(p{k})" for t in texts for k in t.mandatory)
    names = ", ".join(f"({k}, '{t.label}')" for k, t in enumerate(texts))
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
v AS (SELECT unnest([{", ".join(f"'{w}'" for w in vocabulary)}]) AS word),
f AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS word FROM d) GROUP BY word),
idf AS MATERIALIZED (SELECT v.word, ln(((SELECT count(*) FROM d) + 1.0) / (coalesce(f.n, 0) + 1.0)) AS idf FROM v LEFT JOIN f ON v.word = f.word),
p AS MATERIALIZED (SELECT r, doc_id, ws, len(ws) AS n_words, {", ".join(f"{places(t)} AS p{k}" for k, t in enumerate(templates))} FROM d),
tw AS (SELECT t, word, p, idf FROM (VALUES {first}) x(t, word, p) JOIN idf USING (word) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) <= {POSTINGS}),
o AS (SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM p WHERE {mandatory} > 0),
h AS (SELECT r, word FROM (SELECT DISTINCT o.r, o.word, tw.idf FROM o JOIN tw USING (word)) QUALIFY row_number() OVER (PARTITION BY r ORDER BY idf DESC, word) <= {LOOKED_UP}),
vo AS (SELECT DISTINCT r, t, CAST(floor((i - p) / {STRETCH}.0) AS INT) AS b, word FROM o JOIN h USING (r, word) JOIN tw USING (word)),
bu AS (SELECT DISTINCT r, t, b FROM vo),
ag AS (SELECT bu.r, bu.t, bu.b FROM bu JOIN vo ON vo.r = bu.r AND vo.t = bu.t AND vo.b IN (bu.b, bu.b - 1) GROUP BY ALL HAVING count(DISTINCT word) >= {VOTES}),
st AS (SELECT r, t, min(b) AS b FROM ag JOIN p USING (r) WHERE CASE {stands} END GROUP BY r, t),
tx AS (SELECT r, list(label) AS labels, string_agg(label || '@' || ((b - 1) * {STRETCH}), ',' ORDER BY t) AS texts FROM st JOIN (VALUES {names}) x(t, label) USING (t) GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words,
  CAST({" + ".join(f"len(p{k})" for k in base)} AS BIGINT) AS n_base,
  CAST(list_min({every}) AS BIGINT) AS first_word, CAST(list_max({every}) AS BIGINT) AS last_word,
  {label(True)} AS base_labels, {label(False, "tx.labels")} AS labels,
  round(1 - exp(-greatest({", ".join(f"CASE WHEN len(p{k}) > 0 THEN {weight(t)} ELSE 0.0 END" for k, t in enumerate(templates))})), 6) AS score,
  CAST({ends} AS BIGINT) AS last_end, coalesce(tx.texts, '') AS texts
FROM p LEFT JOIN tx USING (r)
"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE_SQL = {"op2_license_scan": _oracle(all_templates(), all_texts())}
