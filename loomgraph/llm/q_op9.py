"""op9: secrets in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.secrets import find_secrets, spans_text, train_pair_ratios, training_samples
from loomgraph.runtime import spread


def secret_report(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """One row of counts and spans for every document, repeated ones included; a null text has no spans."""
    found = find_secrets(docs.select("doc_id", "text"), ratios)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every row of documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return secret_report(docs, train_pair_ratios(training_samples(spark, docs=docs)))


QUERIES = {"op9_secret_scan": op9_secret_scan}
