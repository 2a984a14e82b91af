"""Streaming ingestion with validation: good messages and dead letters in one table, told apart by ``reason``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import shared_dir


def ingest(stream: DataFrame, rules: dict[str, Column], path: str | None = None) -> DataFrame:
    """Runs ``stream`` over all that its source holds now and gives the written table back: its columns and ``reason``,
    the first rule (name: condition) a row breaks, null for good rows. A condition that is null counts as broken. The
    checkpoint lies beside the table, so a rerun on the same path takes new messages only."""
    path = path or f"{shared_dir(stream.sparkSession)}/loomgraph-stream-{uuid.uuid4().hex}"
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    rows = stream.withColumn("reason", F.coalesce(*broken) if broken else F.lit(None).cast("string"))
    run = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
