"""op8: every document as a media payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.media import store_media, stored, with_features, with_header
from loomgraph.runtime import spread


def media_report(docs: DataFrame) -> DataFrame:
    """One row of digests and features for every document, from what was stored; null and repeated texts as in
    ``store_media``. Every payload is read back once, whatever the number of rows that point at it."""
    media = store_media(docs)
    seen = with_features(with_header(stored(media))).select("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", F.concat_ws(";", F.concat(F.lit("size="), F.concat_ws("x", "width", "height", "bits")), "feature").alias("feature"))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature"]
    return media.join(seen, "digest").select(*columns)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every row of documents."""
    return media_report(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op8_media_columns": op8_media_columns}
