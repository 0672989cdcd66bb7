"""Streaming forms of ingest, deduplication, weekly and sliding aggregates.

Sources are file streams over landed snapshots: each file counts once, by the checkpoint. Rows more than `LATE` behind the
newest are late here and dropped; streaming/late keeps them and repairs their weeks, streaming/gold keeps the gold table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators.weekly import weather_aggregates

LATE = "14 days"


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def deduplicated(events: DataFrame, key: str, ts: str) -> DataFrame:
    """The first of rows with the same key within the lateness; state is as large as the keys of that time."""
    return events.withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def weekly_alerts(alerts: DataFrame) -> DataFrame:
    """Monday-to-Sunday aggregates of alerts by port, as the batch form. The epoch was a Thursday, hence the offset."""
    week = F.window("effective", "7 days", "7 days", "4 days")
    out = alerts.withWatermark("effective", LATE).filter("port_id IS NOT NULL").groupBy("port_id", week).agg(*weather_aggregates())
    return out.select("port_id", F.date_sub(F.col("window.end").cast("date"), 1).alias("week_ending"), *[c for c in out.columns if c not in ("port_id", "window")])


def sliding_active(alerts: DataFrame) -> DataFrame:
    """Alerts of each port in the seven days up to each day."""
    window = F.window("effective", "7 days", "1 day")
    out = alerts.withWatermark("effective", LATE).groupBy("port_id", window).agg(F.count("*").alias("active"))
    return out.select("port_id", F.col("window.end").cast("date").alias("day"), "active")


def run_available(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what has landed, then stop."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()


def run_keyed(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what has landed in update mode, then stop: a batch writes the aggregates that it changed, and state that the
    watermark has passed goes. A batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def read_keyed(spark: SparkSession, sink: str, like: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key in a sink of run_keyed. like: a frame with its columns."""
    rest = [c for c in like.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in like.dtypes)}, batch long").parquet(sink)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select(*keys, *[F.col("v")[c].alias(c) for c in rest]).select(*like.columns)
