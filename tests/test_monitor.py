"""Stream counters: windows that close, messages that come late, health and alerts."""

from __future__ import annotations

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from loomgraph.streaming import monitor as M

SCHEMA = "at timestamp_ntz, who string, ok boolean, source int"  # a column with a clashing name


def _send(spark, folder, rows):
    made = [(None if m is None else dt.datetime(2024, 3, 31, 0, 0) + dt.timedelta(minutes=m), who, ok, 1) for m, who, ok in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _count(spark, folder, path):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    found = M.count_messages(stream, "at", F.col("ok"), F.col("who"), "1 hour", "10 minutes", path)
    return sorted((r["source"] or "-", r["start"].hour, r["processed"], r["errors"], r["latest"].minute) for r in found.collect())


def test_windows_close_once_and_late_messages_are_dropped(spark):
    folder, path = tempfile.mkdtemp() + "/in", tempfile.mkdtemp() + "/out"
    _send(spark, folder, [(5, "a", True), (6, "a", None), (7, "a", False), (50, None, True), (None, "a", True), (65, "a", True)])
    assert _count(spark, folder, path) == []  # 1:05 less 10 minutes is not past 1:00
    _send(spark, folder, [(30, "a", True), (75, "b", True)])
    first = [("-", 0, 1, 0, 50), ("a", 0, 2, 2, 30)]
    assert _count(spark, folder, path) == first
    _send(spark, folder, [(10, "a", True), (140, "b", True)])  # the first is too late
    assert _count(spark, folder, path) == [*first, ("a", 1, 1, 0, 5), ("b", 1, 1, 0, 15)]


def test_health_and_alerts(spark):
    rows = [("a", 0, 9, 0), ("a", 1, 1, 1), ("a", 2, 0, 3), ("a", 3, 0, 0), ("b", 0, 1, 9), ("b", 1, 5, 0), (None, 1, 100, 0)]
    counters = spark.createDataFrame(rows, "source string, start int, processed long, errors long")
    got = sorted((r["source"] or "-", r["start"], r["error_rate"], r["alert"]) for r in M.alerts(counters).collect())
    assert got == [("a", 1, 0.5, "raised"), ("a", 3, 0.0, "cleared"), ("b", 0, 0.9, "raised"), ("b", 1, 0.0, "cleared")]
    assert {r["source"]: (r["error_rate"], r["healthy"]) for r in M.health(counters).collect()} == {"a": (4 / 14, False), "b": (9 / 15, False), None: (0.0, True)}
    assert tuple(M.overall_health(counters).first()) == ("degraded", 3, 2)
    assert tuple(M.overall_health(counters.where("source IS NOT NULL")).first()) == ("unhealthy", 2, 2)
    assert tuple(M.overall_health(counters.limit(0)).first()) == ("healthy", 0, 0)
