"""The gold table kept up to date by any of the five feeds.

A batch of a feed changes few rows of the gold table: an event its feed's columns in the row of its port and week, a throughput row
those of its port from its week to REACH rows on, as the frames of the window features look back so far, and all ports' rows of weeks
that the spine didn't have. Only these are computed anew, from the rows they need: feeds are stored by year and week, and what doesn't
matter isn't read. All rows are written again with the first rows of a feed, which count for every row's completeness, and all are
computed anew when throughput replaces the fallback weeks.

The commit log at root says which batches are in, so a batch that runs again changes nothing. A batch that was computed while
another was committed is computed again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions.scalar import sql_date, week_ending
from quaystone.operators import weekly
from quaystone.operators.weekly import KEYS
from quaystone.operators.windows import port_features
from quaystone.registry import FIRE_COLUMNS, NEWS_COLUMNS, QUAKE_COLUMNS, WEATHER_COLUMNS
from quaystone.sources import commits

#: Rows after a throughput row whose features look back at it: the longest frame.
REACH = 52
#: Commits since the last whole table after which it is worth writing one.
COMPACT_AFTER = 50


class Feed(NamedTuple):
    """The columns of a feed that count, the week of a row, and the weekly features of rows."""

    schema: str
    week: Callable[[], Column]
    weekly: Callable[[DataFrame], DataFrame]


FEEDS = {
    "throughput": Feed(
        "port_id string, week_ending date, median_berthing_time_hrs double, avg_berthing_time_hrs double, vessel_call_count int, ingested_at timestamp_ntz",
        lambda: F.col("week_ending").cast("date"), port_features,
    ),
    "weather": Feed("alert_id string, port_id string, event_type string, severity string, effective timestamp_ntz", lambda: week_ending(F.col("effective")), weekly.weather_weekly),
    "news": Feed(
        "global_event_id string, port_id string, sql_date string, event_root_code string, goldstein_scale double, num_mentions double, num_articles double, avg_tone double",
        lambda: week_ending(sql_date(F.col("sql_date"))), weekly.news_weekly,
    ),
    "quakes": Feed("usgs_id string, port_id string, magnitude double, depth_km double, tsunami_flag boolean, occurred_at timestamp_ntz", lambda: week_ending(F.col("occurred_at")), weekly.quake_weekly),
    "fires": Feed("port_id string, frp double, confidence string, acquired_at timestamp_ntz", lambda: week_ending(F.col("acquired_at")), weekly.fire_weekly),
}
COLUMNS = {"weather": WEATHER_COLUMNS, "news": NEWS_COLUMNS, "quakes": QUAKE_COLUMNS, "fires": FIRE_COLUMNS}
EVENTS = list(COLUMNS)


def _shaped(rows: DataFrame, feed: str) -> DataFrame:
    """A feed's columns in their types (what doesn't cast is null), and the week last."""
    kinds = [x.split(" ") for x in FEEDS[feed].schema.split(", ")]
    out = rows.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds]).withColumn("week_ending", FEEDS[feed].week())
    return out.select(*[c for c in out.columns if c != "week_ending"], "week_ending").filter("week_ending IS NOT NULL")


class _State:
    """What the log says: folders of each feed's rows and of gold rows, the range of throughput weeks, feeds with rows."""

    def __init__(self, log: list[dict]):
        self.seen, self.done = len(log), {(e["feed"], e["batch"]) for e in log if "feed" in e}
        self.rows: dict[str, list[str]] = {f: [] for f in FEEDS}
        self.gold: list[tuple[int, str]] = []
        self.first = self.last = None
        for e in log:
            if "compacted" in e:
                self.rows = {f: list(e["compacted"].get(f, [])) for f in FEEDS}
            if e.get("rows"):
                self.rows[e["feed"]].append(e["rows"])
            if e["whole"]:
                self.gold = []
            self.gold.append((e["number"], e["gold"]))
            self.first, self.last = e["first"], e["last"]

    def read(self, spark: SparkSession, root: str, feed: str, weeks: list | None = None) -> DataFrame:
        """The rows of a feed, of some weeks."""
        shape = _shaped(spark.createDataFrame([], FEEDS[feed].schema), feed)
        paths = [f"{root}/{p}" for p in self.rows[feed]]
        if not paths:
            return shape
        df = spark.read.option("basePath", f"{root}/feeds/{feed}").schema(shape.withColumn("year", F.lit(0)).schema).parquet(*paths)
        if weeks is not None:
            df = df.filter(F.col("year").isin(sorted({w.year for w in weeks})) & F.col("week_ending").isin(weeks))
        return df.drop("year")


def _store(rows: DataFrame, path: str) -> None:
    """Rows by year, and inside a file by week, so that readers skip files and row groups of other weeks."""
    rows.repartitionByRange("week_ending").sortWithinPartitions("week_ending").withColumn("year", F.year("week_ending")).write.partitionBy("year").parquet(path)


def _changed_by_throughput(keys: DataFrame, touched: DataFrame) -> DataFrame:
    """keys (port_id, week_ending of all throughput rows) with changed (the row's features change) and needed (a changed row looks at it)."""
    order = Window.partitionBy("port_id").orderBy("week_ending")
    rows = keys.distinct().join(touched.withColumn("hit", F.lit(True)), KEYS, "left").withColumn("n", F.row_number().over(order))
    last = F.max(F.when(F.col("hit"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("changed", F.coalesce(F.col("n") - last <= REACH, F.lit(False)))
    upcoming = F.min(F.when(F.col("changed"), F.col("n"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.select(*KEYS, "changed", F.coalesce(upcoming - F.col("n") <= REACH, F.lit(False)).alias("needed"))


def _weeks(df: DataFrame) -> list:
    """Distinct weeks: as many as there are Sundays in the data."""
    return [r[0] for r in df.select("week_ending").distinct().collect()]


def _event_rows(spark: SparkSession, root: str, state: _State, feed: str, touched: DataFrame, first: bool) -> DataFrame:
    """The gold rows that events change: as they are, with the feed's columns anew. first: the feed's first rows change all of them."""
    rows = read_gold(spark, root, state)
    if first:
        side = state.read(spark, root, feed)
    else:
        keys = touched.join(rows.select(*KEYS), KEYS, "left_semi")
        rows = rows.join(keys, KEYS, "left_semi")
        side = state.read(spark, root, feed, _weeks(keys)).join(keys, KEYS, "left_semi")
    return weekly.assembled(rows.drop(*COLUMNS[feed]), [FEEDS[feed].weekly(side)], [F.lit(int(bool(state.rows[f]))) for f in EVENTS])


def _gold_rows(spark: SparkSession, root: str, state: _State, feed: str, delta: DataFrame, ports: DataFrame, as_of: str | None, whole: bool, old: tuple) -> DataFrame:
    """The gold rows that a batch changes. old: the range of throughput weeks before it."""
    touched = delta.select(*KEYS).distinct()
    if feed != "throughput" and state.gold:
        return _event_rows(spark, root, state, feed, touched, whole)
    bounds = spark.createDataFrame([(state.first,), (state.last,)], "w string").select(F.col("w").cast("date").alias("week_ending"))
    keys, weeks = weekly.gold_spine(ports, bounds, as_of), None
    if whole:
        features = port_features(state.read(spark, root, "throughput"))
    else:
        mine = state.read(spark, root, "throughput").join(touched.select("port_id").distinct(), "port_id", "left_semi")
        marked = _changed_by_throughput(mine.select(*KEYS), touched)
        path = commits.write_rows(marked.filter("needed"), root, "marks")
        marked = spark.read.schema(marked.schema).parquet(f"{root}/{path}")  # keys only, used again and again
        needed = mine.filter(F.col("week_ending").isin(_weeks(marked))).join(marked.select(*KEYS), KEYS, "left_semi")
        changed = marked.filter("changed").select(*KEYS)
        features = port_features(needed).join(changed, KEYS, "left_semi")
        new = keys.filter((F.col("week_ending") < F.lit(old[0]).cast("date")) | (F.col("week_ending") > F.lit(old[1]).cast("date")))
        keys = changed.union(new).distinct()
        weeks = _weeks(keys)
    sides = [features]
    for f in EVENTS:
        rows = state.read(spark, root, f, weeks)
        sides.append(FEEDS[f].weekly(rows if whole else rows.join(keys, KEYS, "left_semi")))
    return weekly.assembled(keys, sides, [F.lit(int(bool(state.rows[f]))) for f in EVENTS])


def refresh(feed: str, rows: DataFrame, batch: int, root: str, ports: DataFrame, as_of: str | None = None) -> bool:
    """Take a batch of a feed in and bring the gold table up to date; whether it was new. as_of: the end of the fallback weeks."""
    spark = rows.sparkSession
    if (feed, batch) in _State(commits.entries(spark, f"{root}/log")).done:
        return False
    name = f"feeds/{feed}/commit={uuid.uuid4().hex}"
    delta = _shaped(rows, feed).join(F.broadcast(ports.select("port_id")), "port_id", "left_semi")
    _store(delta, f"{root}/{name}")
    delta = spark.read.schema(delta.schema).parquet(f"{root}/{name}")
    n, first, last = delta.agg(F.count("*"), F.min("week_ending").cast("string"), F.max("week_ending").cast("string")).first()
    while True:
        state = _State(commits.entries(spark, f"{root}/log"))
        if (feed, batch) in state.done:
            return False
        old = (state.first, state.last)
        whole = not state.gold or (n > 0 and not state.rows[feed])
        if n:
            state.rows[feed].append(name)
            if feed == "throughput":
                state.first, state.last = min(filter(None, (state.first, first))), max(filter(None, (state.last, last)))
        out = None
        if n or whole:
            out = commits.write_rows(_gold_rows(spark, root, state, feed, delta, ports, as_of, whole, old), root, "gold")
        entry = {"feed": feed, "batch": batch, "rows": name if n else None, "gold": out, "whole": whole, "first": state.first, "last": state.last}
        if commits.commit(spark, f"{root}/log", entry, unless=lambda log, seen=state.seen: len(log) != seen) is not None:
            return True


def read_gold(spark: SparkSession, root: str, state: _State | None = None) -> DataFrame:
    """The gold table: the newest row of each port and week since the last whole table."""
    state = state or _State(commits.entries(spark, f"{root}/log"))
    parts = [(number, p) for number, p in state.gold if p]
    if not parts:
        raise FileNotFoundError(f"no gold table at {root}")
    df = spark.read.parquet(*[f"{root}/{p}" for _, p in parts])
    if len(parts) == 1:
        return df
    numbers = F.create_map(*[F.lit(x) for number, p in parts for x in (p.rsplit("/", 1)[1], number)])
    newest = df.withColumn("__commit", numbers[F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)])
    rest = [c for c in df.columns if c not in KEYS]
    return newest.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "__commit").alias("v")).select(*[F.col(c) if c in KEYS else F.col("v")[c].alias(c) for c in df.columns])


def compact(spark: SparkSession, root: str, least: int = COMPACT_AFTER) -> bool:
    """Write the gold table and each feed's rows as one folder each, if that many commits came since the last time; whether it did.
    Readers that have begun go on with the old folders, which stay."""
    while True:
        state = _State(commits.entries(spark, f"{root}/log"))
        if len(state.gold) < least:
            return False
        gold = commits.write_rows(read_gold(spark, root, state), root, "gold")
        kept = {}
        for feed, paths in state.rows.items():
            if paths:
                kept[feed] = [f"feeds/{feed}/commit={uuid.uuid4().hex}"]
                _store(state.read(spark, root, feed), f"{root}/{kept[feed][0]}")
        entry = {"compacted": kept, "gold": gold, "whole": True, "first": state.first, "last": state.last}
        if commits.commit(spark, f"{root}/log", entry, unless=lambda log, seen=state.seen: len(log) != seen) is not None:
            return True


def run_feed(feed: str, df: DataFrame, root: str, checkpoint: str, ports: DataFrame, as_of: str | None = None) -> None:
    """Take in what a feed's stream has, batch by batch, then stop."""

    def put(batch: DataFrame, number: int) -> None:
        refresh(feed, batch, number, root, ports, as_of)
        compact(batch.sparkSession, root)

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
