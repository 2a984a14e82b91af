"""Exact dedup against grouping whole texts in memory, and the trie against a dict."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from helpers import documents, empty, rows_of
from pyspark.sql import functions as F

from loomgraph.llm.exact_dedup import PatriciaTrie, exact_dedup, owners_of
from loomgraph.llm.q_op12 import ORACLE_SQL, op12_exact_dedup


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for ident, text in rows:
        groups[text or ""].append(ident)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = (max(known) if known else None), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(text.encode()).hexdigest()))
            seen |= i == keep
    return sorted(out, key=repr)


def keys(seed: int, n: int) -> list[bytes]:
    """Keys of one length, so that none is a prefix of another, with long shared prefixes."""
    r = random.Random(seed)
    return [bytes(r.choice(b"ab") for _ in range(3)) * r.choice([1, 2, 4]) + b"\0" * 12 for _ in range(n)]


def test_trie_equals_a_dict():
    for seed in range(20):
        trie, want = PatriciaTrie(), {}
        for i, key in enumerate(k[:12] for k in keys(seed, 300)):
            ident = None if i % 11 == 0 else i * 7919 % 101
            trie.insert(key, ident, 1, 1)
            best, top, rows = want.get(key, (None, 0, 0))
            if key not in want or best == ident:
                top += 1
            elif ident is not None and (best is None or ident > best):
                best, top = ident, 1
            want[key] = (ident if key not in want else best, top, rows + 1)
        assert {k: tuple(o) for k, o in trie.drain()} == want
        assert list(trie.drain()) == [] and trie.held == 0


def test_spilled_subtrees_come_out_whole():
    trie, found = PatriciaTrie(), defaultdict(int)
    for key in (k[:12] for k in keys(5, 2000)):
        trie.insert(key, 1, 1, 1)
        if trie.held > 5000:
            for k, owner in trie.spill(2500):
                found[k] += owner[2]
            assert trie.held <= 2500
    for k, owner in trie.drain():
        found[k] += owner[2]
    want = defaultdict(int)
    for key in (k[:12] for k in keys(5, 2000)):
        want[key] += 1
    assert found == want


@pytest.mark.parametrize("held", [1, 20_000, 48 << 20])
def test_rows_equal_brute_force(spark, held):
    extra = [(100 + i, ["same", "same ", "Same", None, ""][i % 5], "en", "s", 4) for i in range(60)]
    extra += [(500, "top twice", "en", "s", 9)] * 3 + [(499, "top twice", "en", "s", 9)] + [(600 + i, "long " * 300_000 + str(i % 2), "en", "s", 9) for i in range(4)]
    docs = documents(spark, extra)
    got = exact_dedup(docs.repartition(3), held_bytes=held)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query_equals_sql(spark, sf_dir, duck):
    got = rows_of(op12_exact_dedup(spark, sf_dir))
    want = sorted(duck.execute(ORACLE_SQL["op12_exact_dedup"]).fetchall(), key=repr)
    assert got == want and any(r[2] > 1 for r in got)


def test_empty_clashing_and_broken(spark):
    assert exact_dedup(empty(spark)).count() == 0
    rows = [(1, "a", "x", 1), (2, "a", "y", 2)]
    clash = spark.createDataFrame(rows, "id int, body string, digest string, owner int")
    got = exact_dedup(clash, "id", "body")
    assert [tuple(r)[:4] for r in got.orderBy("id").collect()] == [(1, 2, 2, False), (2, 2, 2, True)]
    assert got.schema["id"].dataType == clash.schema["id"].dataType
    broken = spark.createDataFrame([(1, bytearray(b"\xff")), (2, bytearray(b"\xff")), (3, bytearray(b"\xfe"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert sorted(r["keep_id"] for r in exact_dedup(broken).collect()) == [2, 2, 3]


def test_texts_of_one_digest_are_told_apart(spark):
    keyed = spark.createDataFrame([(1, 1, bytearray(b"d" * 32), bytearray(b"a")), (2, 1, bytearray(b"d" * 32), bytearray(b"b"))], "id long, n_bytes long, digest binary, body binary")
    with pytest.raises(Exception, match="share their length"):
        owners_of(keyed).collect()


def test_many_repeats_of_one_row(spark):
    docs = spark.range(150_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = exact_dedup(docs)
    assert got.count() == 150_000 and got.where("kept").count() == 1 and got.where("group_size <> 150000").count() == 0
