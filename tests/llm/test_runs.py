"""Periodic runs against a search over all periods and starts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from helpers import TEXTS, documents, empty, rows_of
from pyspark.sql import functions as F

from loomgraph.llm.q_op13 import op13_periodic_runs
from loomgraph.llm.runs import EndPositions, find_runs, find_word_runs, plant_repeats, repeating_stretches, runs_of, suffix_automaton


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every stretch that each period keeps, cut down to its smallest period."""
    n, smallest = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - start >= max(6, 4 * q):
                smallest.setdefault((start, end + q), q)
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in smallest.items())


def plain_row(ident, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listing = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (ident, n, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2], hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def repetitive(r: random.Random) -> list[int]:
    """Words with runs inside runs, broken and shifted ones."""
    out: list[int] = []
    for _ in range(r.randrange(1, 6)):
        unit = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 7))]
        if r.random() < 0.3:
            unit = unit * r.randrange(2, 6) + [r.randrange(3)]
        out += (unit * r.randrange(1, 9))[: r.randrange(1, 60)]
        if r.random() < 0.4 and out:
            out[r.randrange(len(out))] = r.randrange(60)
    return out


def test_runs_equal_brute_force():
    r = random.Random(7)
    some = 0
    for _ in range(1500):
        words = repetitive(r)
        want = plain_runs(words)
        assert runs_of(words) == want, words
        assert find_runs([b"%d" % w for w in words]) == want, words
        some += len(want) > 1
    assert some > 200
    for words in ([], [1], [1] * 5, [1] * 6, [1] * 1000, [1, 2] * 4, [1, 2] * 3 + [1], [1, 2, 3] * 3, ([1] * 6 + [2]) * 5):
        assert find_runs([b"%d" % w for w in words]) == plain_runs(words)


def test_short_alphabets_exhaustively():
    for n in range(6, 12):
        for x in range(2**n):
            words = [x >> i & 1 for i in range(n)]
            assert runs_of(words) == plain_runs(words)


def test_automaton_holds_each_substring_once():
    words = [1, 2, 2, 1, 2, 2, 3, 1, 2]
    length, link, _ = suffix_automaton(words)
    assert sum(length[s] - length[link[s]] for s in range(1, len(length))) == len({tuple(words[i:j]) for i in range(9) for j in range(i + 1, 10)})


def test_end_positions_name_neighbours():
    r = random.Random(1)
    order = list(range(5000))
    r.shuffle(order)
    held, plain = EndPositions(order[0]), [order[0]]
    for p in order[1:3000]:
        before, after = held.neighbours(p)
        held.add(p)
        assert before == max((x for x in plain if x < p), default=None) if p % 97 == 0 else True
        assert after == min((x for x in plain if x > p), default=None) if p % 97 == 0 else True
        plain.append(p)
    assert list(held) == sorted(plain) and held.size == 3000


def test_stretches_leave_out_what_repeats_elsewhere_only():
    line = list(range(10))
    assert repeating_stretches(np.array(line + [99] + line, np.int64)) == []
    assert repeating_stretches(np.array([50, *[1, 2, 3] * 5, 60], np.int64)) == [(1, 16)]


def test_rows_equal_brute_force(spark, sf_dir):
    texts = ["a " * 7, "x y x y x y x y", "one two " * 40 + "three", "a b c d " * 3, "a b " * 9, "\x0b".join("pq" * 12)]
    docs = documents(spark, [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert rows_of(find_word_runs(docs, planted=True)) == want
    planted = [i for i in range(3000, 3400) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(planted) > 20
    words = "the cat sat on a mat and then went home to eat its fish".split()
    long = spark.createDataFrame([(i, " ".join((words * (1 + i % 9))[: 5 + i % 90]), "en", "s", 1) for i in range(3000, 3400)], docs.schema)
    assert rows_of(find_word_runs(long, planted=True)) == sorted((plain_row(r["doc_id"], r["text"]) for r in long.collect()), key=repr)
    got = {r[0]: r for r in rows_of(op13_periodic_runs(spark, sf_dir))}
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 6000).collect()
    assert own and all(tuple(got[r["doc_id"]]) == plain_row(r["doc_id"], r["text"]) for r in own)


def test_kept_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "go on and on and on and on and on stop", "x")], "doc_id long, text string, runs string")
    (row,) = find_word_runs(docs, keep=True).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 9, 2)] and bytes(row["collapsed"]) == b"go on and stop"


def test_very_long_empty_and_broken(spark):
    assert find_word_runs(empty(spark)).count() == 0
    assert rows_of(find_word_runs(spark.createDataFrame([(1, None)], "doc_id int, text string")))[0][:4] == (1, 0, 0, None)
    long = " ".join(["w"] * 60_000 + [f"v{i}" for i in range(60_000)] + ["p q r"] * 20_000)
    broken = spark.createDataFrame([(1, bytearray(b"\xff\xfe \xff\xfe \xff\xfe \xff\xfe \xff\xfe \xff\xfe"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    rows = rows_of(find_word_runs(spark.createDataFrame([(2, long)], "doc_id long, text string").unionByName(broken)))
    assert rows[0][:7] == (1, 6, 1, 0, 6, 1, 6000) and rows[1][:7] == (2, 180_000, 2, 0, 60_000, 1, 60_000_000)


def test_planting_keeps_the_number_of_words():
    for i in range(500):
        words = [b"w%d" % k for k in range(i % 40)]
        assert len(plant_repeats(words, i)) == len(words)
    assert plant_repeats([b"a", b"b"], None) == [b"a", b"b"] and len(TEXTS) > 20
