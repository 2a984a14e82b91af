"""Alignment against the libraries run on whole texts and a search over common ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from helpers import TEXTS, documents, empty, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm.align import CHUNKS, Chunks, align_documents, aligned_texts, byte_alphabet, group_ends, overlaps, pair_counts, tokenizers_of
from loomgraph.llm.q_op11 import op11_token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NUMBERS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text: str | None, libraries) -> list[tuple[list[int], list[int]]]:
    """Groups of a whole text between the offsets where tokens of both end."""
    if not text:
        return []
    a, b = libraries
    letters = byte_alphabet()
    whole = (" " + text).encode()
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends = [set(np.cumsum(list(map(len, x))).tolist()) for x in (a_bytes, b_bytes)]
    common, groups = ends[0] & ends[1], []
    for ids, pieces in ((a_ids, a_bytes), (b_ids, b_bytes)):
        at, own, side = 0, [], []
        for i, piece in zip(ids, pieces, strict=True):
            at += len(piece)
            own.append(i)
            if at in common:
                side.append(own)
                own = []
        groups.append(side)
    return list(zip(*groups, strict=True))


def plain(rows: list[tuple], libraries) -> list[tuple]:
    found = [(i, plain_groups(t, libraries)) for i, t in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    count = Counter(p for x in links for p in x)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (i, groups), own in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), own.total(), best, sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def noise(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    alphabet = ["a", "be", "é", " ", "  ", "\n", "\t ", "'s", "'re", "Ω", "漢字", "👍", "1", "23", "_", ".", "!?", "\x00", "\xa0", " ", "\x1f", "　", "the", " of", "Word", "ſ", "\r\n", "<s>", "<0x41>", "ing"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("share", [1 << 20, 50, 1])
def test_rows_equal_the_libraries(spark, libraries, share):
    extra = [(1000 + i, t, "en", "s", 1) for i, t in enumerate([*noise(3, 150), "a▁b", "▁", "ab" * 3000, "x y" * 50 + "  ", "end \n", "end\n ", "   q", "<|endoftext|> a"])]
    docs = documents(spark, extra)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    assert rows_of(align_documents(docs.repartition(3), A, B, share=share)) == want
    assert any(r[1] == 0 for r in want) and any(0 < r[5] < r[4] for r in want)


def test_query_equals_the_libraries(spark, sf_dir, libraries):
    got = op11_token_alignment(spark, sf_dir)
    assert got.columns == NUMBERS
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(got) == plain([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)


def test_counts_of_pairs(spark, libraries):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cat the cat"), (3, "the dog"), (3, None), (None, "the dog")], "doc_id long, text string")
    counts = pair_counts(aligned_texts(docs, A, B), libraries[1].get_piece_size())
    got = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in counts.collect()}
    count = Counter(p for (t,) in docs.select("text").collect() for p in {(x, y) for a, b in plain_groups(t, libraries) for x in a for y in b})
    assert {p: n for p, (n, _) in got.items()} == dict(count)
    assert {p for p, (_, best) in got.items() if best} == {p for p in count if count[p] == max(n for q, n in count.items() if q[0] == p[0])}


def test_a_has_no_token_its_merges_miss(libraries):
    letters = byte_alphabet()
    pieces = {i: bytes(letters[c] for c in t) for t, i in libraries[0].get_vocab().items() if t != "<|endoftext|>"}
    texts = {i: p.decode() for i, p in pieces.items() if not any(0xFF >= x >= 0x80 for x in p)}
    single = [(i, t) for i, t in texts.items() if len(tokenizers_of(A, B).a.encode_ordinary(t)) == 1]
    assert len(single) > 45_000
    assert all(e.ids == [i] for (i, _), e in zip(single, libraries[0].encode_batch([t for _, t in single], add_special_tokens=False), strict=True))


def test_index_names_overlaps_and_gaps():
    low, high = overlaps(np.array([2, 3, 1, 4]), np.array([2, 1, 1, 2, 2, 2]))
    assert low.tolist() == [0, 1, 3, 4] and high.tolist() == [1, 4, 4, 6]
    assert [x.tolist() for x in group_ends(low, high)] == [[1, 3, 4], [1, 4, 6]]


def test_chunks_tile_texts():
    for text in [*filter(None, TEXTS), *noise(9, 300)]:
        cut = CHUNKS.findall(" " + text)
        assert "".join(cut) == " " + text and all(c[0] == " " for c in cut)


def test_wide_groups_and_forgotten_chunks(monkeypatch, libraries):
    from loomgraph.llm import align

    texts = [t.encode() if t else None for t in [*TEXTS, *noise(4, 60)]]
    whole = Chunks(tokenizers_of(A, B))
    number, text, _ = whole.texts(texts)
    want = [x.tolist() for x in whole.pairs(*whole.distinct(number, text))]
    monkeypatch.setattr(align, "WIDE", 0)
    monkeypatch.setattr(align, "REMEMBERED", 1)
    other = Chunks(tokenizers_of(A, B))
    other.texts([b"some other words first"])
    number, text, _ = other.texts(texts)
    assert [x.tolist() for x in other.pairs(*other.distinct(number, text))] == want


def test_groups_empty_broken_and_clashing(spark, libraries):
    assert align_documents(empty(spark), A, B).count() == 0
    docs = spark.createDataFrame([(1, "naïve  approach", 0, "p")], "id int, body string, row int, pairs string")
    (row,) = align_documents(docs, A, B, "id", "body", keep_groups=True).collect()
    assert [(list(g["a"]), list(g["b"])) for g in row["groups"]] == plain_groups("naïve  approach", libraries)
    broken = spark.createDataFrame([(1, bytearray(b"\xff a"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert rows_of(align_documents(broken, A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_very_long_text(spark, libraries):
    text = "Zq" * 20_000 + " and more words" * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows_of(align_documents(docs, A, B)) == plain([(1, text)], libraries)
