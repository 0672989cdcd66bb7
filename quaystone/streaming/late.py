"""Weekly aggregates of a stream with late rows kept and repaired.

Each micro-batch is one commit: its partial aggregates, and beside them the rows that came too late, behind the watermark (the
newest event time of the batches before it, less the lateness). A batch that runs again finds its commit and adds nothing.
Aggregates are read by merging the partial ones, so the table has on-time rows at once; reconcile() turns the late rows that no
reconciliation had yet into partial aggregates of their own, which repairs just the weeks they belong to. compact() merges all
partial aggregates into one folder, so that reading doesn't slow down with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.operators.weekly import KEYS, weather_weekly
from quaystone.sources import commits


class Partial(NamedTuple):
    """Aggregates that can be made of parts: schema of the rows that count, event time, of rows, and of partial aggregates."""

    schema: str
    ts: str
    of_rows: Callable[[DataFrame], DataFrame]
    merged: dict[str, Callable[[str], Column]]


_SUMS, _LARGEST = ("alert_count", "extreme_alert_count", "severe_alert_count"), ("has_hurricane_alert", "has_high_wind_alert", "has_flood_alert", "has_fog_alert", "max_severity_score")
ALERTS = Partial("alert_id string, port_id string, event_type string, severity string, effective timestamp", "effective", weather_weekly, {**dict.fromkeys(_SUMS, F.sum), **dict.fromkeys(_LARGEST, F.max)})


def _merged(df: DataFrame, kind: Partial) -> DataFrame:
    return df.groupBy(*KEYS).agg(*[f(c).alias(c) for c, f in kind.merged.items()])


def _empty(spark: SparkSession, kind: Partial) -> DataFrame:
    return kind.of_rows(spark.createDataFrame([], kind.schema))


def _parts(log: list[dict]) -> list[str]:
    """Folders of partial aggregates that count: those since the last compaction, and its own."""
    out: list[str] = []
    for e in log:
        out = [] if e.get("compacted") else out
        out += [e["parts"]] if e["parts"] else []
    return out


def take_in(batch: DataFrame, number: int, root: str, kind: Partial, late_seconds: int) -> bool:
    """Commit a micro-batch; whether it was new."""
    spark = batch.sparkSession
    log = commits.entries(spark, f"{root}/log")
    known = lambda log: any(e.get("batch") == number for e in log)
    if known(log):
        return False
    newest = max((e["newest"] for e in log if e.get("newest") is not None), default=None)
    ts, rows = F.unix_micros(F.col(kind.ts)), batch.select(*[x.split(" ")[0] for x in kind.schema.split(", ")])
    late = F.lit(False) if newest is None else F.coalesce(ts < F.lit(newest - late_seconds * 1_000_000), F.lit(False))
    n, n_late, top = rows.agg(F.count("*"), F.count_if(late), F.max(ts)).first()
    parts = commits.write_rows(kind.of_rows(rows.filter(~late)), root, "parts") if n > n_late else None
    aside = commits.write_rows(rows.filter(late), root, "late") if n_late else None
    entry = {"batch": number, "parts": parts, "late": aside, "newest": top, "rows_in": n, "rows_late": n_late}
    return commits.commit(spark, f"{root}/log", entry, unless=known) is not None


def run(df: DataFrame, root: str, checkpoint: str, kind: Partial = ALERTS, late_seconds: int = 14 * 86_400) -> None:
    """Take in what the stream has, then stop."""
    stream = df.writeStream.foreachBatch(lambda batch, number: take_in(batch, number, root, kind, late_seconds))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, root: str, kind: Partial = ALERTS) -> DataFrame:
    """The weekly aggregates of all rows that count so far."""
    parts = _parts(commits.entries(spark, f"{root}/log"))
    empty = _empty(spark, kind)
    return _merged(spark.read.schema(empty.schema).parquet(*[f"{root}/{p}" for p in parts]), kind) if parts else empty


def late_rows(spark: SparkSession, root: str, kind: Partial = ALERTS) -> DataFrame:
    """Late rows that wait for a reconciliation."""
    return _waiting(spark, root, kind, commits.entries(spark, f"{root}/log"))[0]


def _waiting(spark: SparkSession, root: str, kind: Partial, log: list[dict]) -> tuple[DataFrame, list[int]]:
    done = {n for e in log for n in e.get("reconciled", [])}
    todo = [e for e in log if e.get("late") and e["batch"] not in done]
    if not todo:
        return spark.createDataFrame([], kind.schema), []
    return spark.read.schema(kind.schema).parquet(*[f"{root}/{e['late']}" for e in todo]), [e["batch"] for e in todo]


def reconcile(spark: SparkSession, root: str, kind: Partial = ALERTS) -> int:
    """Add the late rows to their weeks; how many batches had some. Two that run at a time don't add a row twice."""
    while True:
        log = commits.entries(spark, f"{root}/log")
        rows, batches = _waiting(spark, root, kind, log)
        if not batches:
            return 0
        parts = commits.write_rows(kind.of_rows(rows), root, "parts")
        mine = set(batches)
        if commits.commit(spark, f"{root}/log", {"reconciled": batches, "parts": parts}, unless=lambda log: any(mine & set(e.get("reconciled", [])) for e in log)) is not None:  # noqa: B023
            return len(batches)


def compact(spark: SparkSession, root: str, kind: Partial = ALERTS, least: int = 50) -> bool:
    """Merge the partial aggregates into one folder, if there are that many; whether it did."""
    while True:
        log = commits.entries(spark, f"{root}/log")
        if len(_parts(log)) < least:
            return False
        parts = commits.write_rows(read(spark, root, kind), root, "parts")
        if commits.commit(spark, f"{root}/log", {"compacted": True, "parts": parts}, unless=lambda now, seen=len(log): len(now) != seen) is not None:
            return True
