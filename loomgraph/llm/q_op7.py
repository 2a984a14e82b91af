"""op7: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.language_id import PpmTables, identify, train
from loomgraph.runtime import spread


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learned_tables(docs: DataFrame) -> PpmTables | None:
    """Statistics of the labelled documents that are not held out."""
    return train(docs.where(~held_out()))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte); learns from labelled documents that are not held out."""
    return identify(docs, learned_tables(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every row of documents; null texts and texts without a letter are und."""
    return predict_languages(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op7_language_id": op7_language_id}
