"""Similarity of known fields against that of maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S


def test_field_similarity_is_that_of_maps(spark):
    values = [(None, "1"), ("Small", None), ("small ", "12"), ("LARGE", "21"), ("", "1"), (None, None)]
    df = spark.createDataFrame([(*a, *b) for a in values for b in values], "t string, z string, u string, w string")
    record = lambda x, y: F.create_map(F.lit("type"), F.col(x), F.lit("size"), F.col(y))
    got = df.select(S.property_similarity(record("t", "z"), record("u", "w")).alias("a"), S.field_similarity([(F.col("t"), F.col("u")), (F.col("z"), F.col("w"))]).alias("b")).collect()
    assert all(abs(r["a"] - r["b"]) < 1e-12 for r in got)
