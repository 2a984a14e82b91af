"""Token counts and byte-level BPE against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from helpers import TEXTS, documents, empty, rows_of
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import decode_documents, decode_range, encode_documents, encode_texts, ranks_of
from loomgraph.llm.q_op4 import round_trip_digests
from loomgraph.llm.token_counts import chars_within, count_tokens, counter, token_prefix_steps, tokens_at

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def byte_level():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    alphabet = "abcdeé 'stremvl\n\t  Ω漢👍1²-_.!\x00\x1f́ſK"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library(spark, sf_dir, pieces):
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = rows_of(docs.select("doc_id", "text"))
    want = sorted(((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t in texts), key=repr)
    got = count_tokens(docs, MODEL)
    assert rows_of(got.drop("chars_within_limit")) == want
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for r in count_tokens(own, MODEL, limit=50).join(own, "doc_id").where("over_limit").collect():
        n = r["chars_within_limit"]
        assert len(pieces.encode(r["text"][:n])) <= 50 and all(len(pieces.encode(r["text"][: n + k])) > 50 for k in range(1, 12))
    assert {r["chars_within_limit"] == len(r["text"] or "") for r in count_tokens(own, MODEL).where("not over_limit").join(own, "doc_id").collect()} == {True}


def test_every_prefix_has_its_count(pieces):
    own = counter(MODEL)
    for text in [*[t for t in TEXTS if t and len(t) < 200], *noise(1, 40)]:
        steps = own.text_steps(text)
        total = 0
        for i in range(len(text)):
            total += int(steps[i])
            assert total == len(pieces.encode(text[: i + 1])), (text, i)


def test_prefix_questions(spark, pieces):
    text = "The quick brown fox jumps over the lazy dog, naïvely."
    df = token_prefix_steps(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), MODEL)
    got = {r[0]: r[1:] for r in df.select("doc_id", tokens_at(F.col("steps"), 9), chars_within(F.col("steps"), 5)).collect()}
    longest = max(i for i in range(len(text) + 1) if len(pieces.encode(text[:i])) <= 5)
    assert got[1] == (len(pieces.encode(text[:9])), longest)
    assert got[2] == (0, 0)


def test_byte_bpe_ids_equal_the_library(spark, sf_dir, byte_level):
    texts = [t for t in TEXTS if t is not None] + noise(2, 300)
    assert encode_texts(texts, ranks_of(RANKS)) == byte_level.encode_ordinary_batch(texts)
    docs = documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    want = []
    for i, t in rows_of(docs.select("doc_id", "text")):
        ids = byte_level.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(round_trip_digests(docs, RANKS).drop("last_offset")) == sorted(want, key=repr)


def test_offsets_and_decoding(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    pieces = ranks_of(RANKS).pieces
    encoded = encode_documents(docs, RANKS)
    for r in encoded.collect():
        for i, at in zip(r["ids"], r["offsets"], strict=True):
            assert texts[r["doc_id"]][at : at + len(pieces[i])] == pieces[i]
    assert {r["doc_id"]: bytes(r["bytes"]) for r in decode_documents(encoded, RANKS).collect()} == texts
    for a, b in ((0, 5), (3, 40), (7, 7), (100, 10**6)):
        assert {r["doc_id"]: bytes(r["bytes"]) for r in decode_range(encoded, RANKS, a, b).collect()} == {i: t[a:b] for i, t in texts.items()}


def test_empty_tables_and_clashing_columns(spark):
    assert count_tokens(empty(spark), MODEL).collect() == []
    assert round_trip_digests(empty(spark), RANKS).collect() == []
    docs = documents(spark)
    clash = docs.withColumns({c: F.lit("x") for c in ("n_tokens", "steps", "ids", "bytes", "offsets", "n_bytes")})
    assert rows_of(count_tokens(clash, MODEL)) == rows_of(count_tokens(docs, MODEL))
    assert rows_of(round_trip_digests(clash, RANKS)) == rows_of(round_trip_digests(docs, RANKS))
