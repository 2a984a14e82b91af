"""Queries of stream counters, health and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.streaming import monitor as M


def _counters(spark, d):
    """Events by hour of the day's quarter; errors are those of that type and small values."""
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a pattern may match a file or a folder
    return M.count_messages(stream, "ts", (F.col("event_type") != "error") & (F.col("value") >= 2), F.concat(F.lit("s"), F.col("user_id") % 5), "6 hours", "1 hour")


def stream_counters(spark, d):
    return _counters(spark, d)


def stream_health(spark, d):
    return M.health(_counters(spark, d), 0.28)


def stream_overall(spark, d):
    return M.overall_health(_counters(spark, d), 0.28)


def stream_alerts(spark, d):
    return M.alerts(_counters(spark, d), 0.3)


QUERIES = {f.__name__: f for f in (stream_counters, stream_health, stream_overall, stream_alerts)}

_COUNTERS = """WITH e AS (SELECT 's' || (user_id % 5) AS source, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, ts, coalesce(event_type <> 'error' AND value >= 2, false) AS ok FROM events WHERE ts IS NOT NULL),
c AS (SELECT source, start, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS errors, max(ts) AS latest FROM e GROUP BY source, start HAVING start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
h AS (SELECT source, sum(processed)::BIGINT AS processed, sum(errors)::BIGINT AS errors, sum(errors) / (sum(processed) + sum(errors)) AS error_rate, sum(errors) / (sum(processed) + sum(errors)) < 0.28 AS healthy FROM c GROUP BY source)"""
ORACLE_SQL = {
    "stream_counters": f"{_COUNTERS} SELECT * FROM c",
    "stream_health": f"{_COUNTERS} SELECT * FROM h",
    "stream_overall": f"{_COUNTERS} SELECT CASE WHEN bool_and(healthy) THEN 'healthy' WHEN NOT bool_or(healthy) THEN 'unhealthy' ELSE 'degraded' END AS overall, count(*) AS sources, count(*) FILTER (NOT healthy) AS unhealthy FROM h",
    "stream_alerts": f"{_COUNTERS}, b AS (SELECT *, errors / (processed + errors) AS error_rate FROM c), w AS (SELECT *, error_rate >= 0.3 AS bad, coalesce(lag(error_rate >= 0.3) OVER (PARTITION BY source ORDER BY start), false) AS was FROM b) SELECT source, start, error_rate, CASE WHEN bad THEN 'raised' ELSE 'cleared' END AS alert FROM w WHERE bad <> was",
}
