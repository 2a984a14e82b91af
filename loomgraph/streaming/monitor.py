"""Counters of a stream by source and window, its health, and alerts where that changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from loomgraph.runtime import shared_dir

#: Fixed value: the share of errors from which on a source is unhealthy.
ERROR_RATE = 0.1
#: Watermarks need instants; times without a zone are counted from here.
EPOCH = "1970-01-01 00:00:00"


def count_messages(stream: DataFrame, at: str, ok: Column, source: Column, window: str = "1 hour", late: str = "10 minutes", path: str | None = None) -> DataFrame:
    """(source, start, processed, errors, latest) for each closed window of each source, as the written table that
    ``stream`` fills with all that its source holds now.

    ``at`` is the time column of a message (without a time zone it is read as UTC, and given back without one); ``ok`` null or false makes it an error. A window closes once a message is
    ``late`` past its end: it is then written, once, and later messages of it are dropped, so the state holds open windows only. Windows
    still open are kept in the checkpoint beside the table, and a rerun on the same path goes on with them. Messages without
    a time belong to no window and are not counted; a null source is one of its own. Counts are summed up
    before they are shuffled, so a source that sends most messages costs one row for each task and window."""
    path = path or f"{shared_dir(stream.sparkSession)}/loomgraph-counters-{uuid.uuid4().hex}"
    good = F.coalesce(ok, F.lit(False))
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    local = stream.schema[at].dataType == TimestampNTZType()
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(at))) if local else F.col(at)
    given = (lambda c: epoch + F.make_dt_interval(secs=F.unix_micros(c).cast("decimal(18,0)") / 1_000_000)) if local else (lambda c: c)
    rows = stream.select(instant.alias("_at"), source.alias("source"), good.alias("_ok")).withWatermark("_at", late)
    counted = rows.groupBy(F.window("_at", window).alias("_w"), "source").agg(F.count_if("_ok").alias("processed"), F.count_if(~F.col("_ok")).alias("errors"), F.max("_at").alias("latest"))
    out = counted.select("source", given(F.col("_w.start")).alias("start"), "processed", "errors", given(F.col("latest")).alias("latest"))
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


def health(counters: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(source, processed, errors, error_rate, healthy) over all windows of ``counters``; the rate is 0 without messages."""
    total = counters.groupBy("source").agg(F.sum("processed").alias("processed"), F.sum("errors").alias("errors"))
    return total.withColumn("error_rate", _rate()).withColumn("healthy", F.col("error_rate") < error_rate)


def overall_health(counters: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(overall, sources, unhealthy), one row: healthy, degraded if some sources are not, unhealthy if none is. Without
    sources it is healthy."""
    known = health(counters, error_rate).agg(F.count("*").alias("sources"), F.count_if(~F.col("healthy")).alias("unhealthy"))
    state = F.when(F.col("unhealthy") == 0, "healthy").when(F.col("unhealthy") == F.col("sources"), "unhealthy").otherwise("degraded")
    return known.select(state.alias("overall"), "sources", "unhealthy")


def alerts(counters: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """(source, start, error_rate, alert): windows in which a source turns unhealthy ("raised") or healthy again
    ("cleared"), against its window before; the first is compared with a healthy one. Windows without messages are not
    in ``counters`` and change nothing. ``counters`` has one row for each source and window."""
    bad = counters.withColumn("error_rate", _rate()).withColumn("_bad", F.col("error_rate") >= error_rate)
    was = F.coalesce(F.lag("_bad").over(W.partitionBy("source").orderBy("start")), F.lit(False))
    turned = bad.withColumn("_was", was).where("_bad <> _was")
    return turned.select("source", "start", "error_rate", F.when(F.col("_bad"), "raised").otherwise("cleared").alias("alert"))


def _rate() -> Column:
    total = F.col("processed") + F.col("errors")
    return F.when(total > 0, F.col("errors") / total).otherwise(0.0)
