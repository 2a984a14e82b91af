"""Texts that are not valid UTF-8, which Spark strings can hold, are read with U+FFFD in their place."""

from __future__ import annotations

import public_tokenizers as P
from helpers import rows_of
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import encode_documents
from loomgraph.llm.language_id import identify, train
from loomgraph.llm.media import store_media
from loomgraph.llm.ngram_join import link_documents
from loomgraph.llm.token_counts import count_tokens

RAW = b"some \xff\xfe broken \xc3 words of text"


def pair(spark):
    """The same text broken, and with replacement characters."""
    rows = [(1, bytearray(RAW)), (2, bytearray(RAW.decode(errors="replace").encode()))]
    return spark.createDataFrame(rows, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"))


def test_every_operator_reads_them_alike(spark):
    docs = pair(spark)
    same = lambda df: len({r[1:] for r in rows_of(df)}) == 1
    assert same(count_tokens(docs, P.path("piece_bpe_32k.model")))
    assert same(encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), decode=True).select("doc_id", F.concat_ws(",", F.col("ids").cast("array<string>")), F.hex("bytes")))
    assert [r["component_id"] for r in link_documents(docs, width=3, num=90, den=100).collect()] == [1, 1]
    assert same(identify(docs, train(docs), keep=["text"]))
    assert same(store_media(docs).select("doc_id", "n_bytes", "digest"))
