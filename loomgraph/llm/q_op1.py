"""op1: token counts of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.token_counts import count_tokens
from loomgraph.runtime import spread


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents, repeated ones included; a null text counts as empty. All counts are read from the
    written table that holds the steps of every prefix."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


QUERIES = {"op1_token_counts": op1_token_counts}
