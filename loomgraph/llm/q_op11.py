"""op11: tokens of two tokenizers aligned in every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.align import align_documents
from loomgraph.runtime import spread


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents, repeated ones included; texts without tokens, null ones among them, have zeros."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
