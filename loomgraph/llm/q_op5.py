"""op5: a verdict on the URL of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.url_filter import filter_urls, labelled_urls, train_url_model


_TRAINED: dict = {}


def trained(spark: SparkSession):
    """The model and its suffix statistics, fitted once for each application: the labelled URLs are always the same."""
    key = spark.sparkContext.applicationId
    if key not in _TRAINED:
        _TRAINED[key] = train_url_model(labelled_urls(spark))
    return _TRAINED[key]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict for every row of pages; null urls as in ``filter_urls``."""
    model, suffix_rates = trained(spark)
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), model, suffix_rates)


QUERIES = {"op5_url_filter": op5_url_filter}
