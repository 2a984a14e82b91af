"""op4: byte-level BPE of every document, there and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.byte_bpe import encode_documents
from loomgraph.runtime import spread


def round_trip_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, last_offset) of every row, repeated ones included; the bytes are
    decoded by the tokens' offsets. last_offset: where the last token starts, null for a null or empty text."""
    decoded = encode_documents(docs, ranks_path, keep_offsets=True, decode=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        F.try_element_at("offsets", F.lit(-1)).cast("long").alias("last_offset"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every row of documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
