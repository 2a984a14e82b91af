"""Mentions, co-occurrence and coreference on awkward texts, against Python's own matcher."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomgraph.operators import mentions as M

TEXTS = [
    (1, "Anna Berg met Small Ring Inc. in Bonn City on 12/03/1997. She liked it, they agreed in 1998."),
    (2, None), (3, ""), (4, "it rained"), (5, "éAnna Berg Annaé Berg Anna Bergé Foo_Bar Inc 19971 1997"),
    (6, "Foo Inc Bar Baz\nQux Company"), (7, "Anna Berg " * 7000), (1, "Anna Berg again 1999"),
    (9, "Foo Bar Incä. Foo Inc9 Big Foo Inc Old Bar Ltd. New Baz Foo_Bar Inc Foo Company. X Corp Aa Corp"),
    (8, "👩 Anna Berg 👩‍👩‍👧 his 1-2-1999/1-2-99"),
]


#: The patterns as a matcher that may give back repeated groups has them.
PLAIN = {
    "ORG": r"(?<!\w)[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Inc|Corp|LLC|Ltd|Company)(?:\.|(?!\w))",
    "PERSON": r"(?<!\w)[A-Z][a-z]+(?:\s+(?!Inc|Corp|LLC|Ltd|Company)[A-Z][a-z]+)+(?!\w)",
    "GPE": r"(?<!\w)[A-Z][a-z]+\s*(?:City|State|Country|Nation)(?!\w)",
    "DATE": r"(?<!\w)(?:[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4})(?!\w)",
}


def plain_mentions(rows):
    return [(i, label, m.start(), m.end(), m[0]) for i, t in rows for label, p in PLAIN.items() for m in re.finditer(p, t or "")]


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "id long, text string, label string")


def test_mentions_equal_a_plain_search(spark):
    found = M.find_mentions(frame(spark), ["id"], "text")
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(plain_mentions(TEXTS))
    assert {r["confidence"] for r in found.collect()} == {0.7}
    assert M.find_mentions(frame(spark).limit(0), ["id"], "text").count() == 0


def test_running_sums_over_blocks(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(2000)).alias("v")).unionAll(spark.range(1).select(F.array().cast("array<int>")))
    got = [r[0] for r in df.select(M.running_sums(F.col("v"))).collect()]
    assert sorted(got, key=len) == [[], [n * (n + 1) // 2 for n in range(1, 2001)]]


def test_pairs_equal_all_pairs(spark):
    rows = [(i, t) for i, t in TEXTS if i != 7]
    for within in (1, 12, 100):
        want = []
        for key in {i for i, _ in rows}:
            mine = sorted((s, e, label, m, k) for k, (i, label, s, e, m) in enumerate(plain_mentions(rows)) if i == key)
            want += [(key, a[3], a[0], b[3], b[0], abs(a[1] - b[0])) for n, a in enumerate(mine) for b in mine[n + 1 :] if abs(a[1] - b[0]) < within]
        found = M.co_occurrences(M.find_mentions(frame(spark).where("id <> 7"), ["id"], "text"), ["id"], within)
        assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(want)
    twice = spark.createDataFrame([(1, "PERSON", 0, 9, "Anna Berg")] * 3 + [(None, "PERSON", 0, 9, "Anna Berg")] * 2, "id long, label string, start long, end long, mention string")
    assert M.co_occurrences(twice, ["id"]).count() == 3


def test_pronouns_and_chains(spark):
    docs = frame(spark).where("id IN (2, 3, 4, 6, 8) OR text LIKE '%She%'")
    found = {(r["id"], r["pronoun"]): (r["antecedent"], r["antecedent_label"]) for r in M.resolve_pronouns(docs, ["id"], "text").collect()}
    assert found == {(1, "She"): ("Bonn City", "PERSON"), (1, "it"): ("12/03/1997", "DATE"), (1, "they"): ("Bonn City", "PERSON"), (4, "it"): (None, None), (8, "his"): ("Anna Berg", "PERSON")}
    chains = {(r["id"], r["entity"], r["label"]): (r["mentions"], r["pronouns"], r["first_start"]) for r in M.coreference_chains(docs, ["id"], "text").collect()}
    assert chains[1, "anna berg", "PERSON"] == (1, 0, 0) and chains[1, "bonn city", "PERSON"][:2] == (1, 2) and chains[8, "anna berg", "PERSON"] == (1, 1, 2)
    assert M.coreference_chains(docs.limit(0), ["id"], "text").count() == 0


def test_mentions_of_messages_are_dealt_out_and_not_broadcast(spark, sf_dir):
    from loomgraph.plans import q_mentions

    assert q_mentions._messages(spark, sf_dir).rdd.getNumPartitions() >= 8
    plan = q_mentions.cooccurrences_in_messages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
