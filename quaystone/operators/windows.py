"""Window operators over (port_id, week_ending). Frames count rows, not days. One sort serves all columns of a port."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_week():
    return Window.partitionBy("port_id").orderBy("week_ending")


def frame(rows: int, last: int = 0):
    return by_week().rowsBetween(last - rows + 1, last)


def guarded(x: Column, value, rows: int, least: int, last: int = 0) -> Column:
    """value over the last rows, if the frame has `least` values of x."""
    over = frame(rows, last)
    return F.when(F.count(x).over(over) >= least, value.over(over))


def rolling_mean(x: Column, rows: int, least: int) -> Column:
    return guarded(x, F.avg(x), rows, least)


def rolling_std(x: Column, rows: int, least: int) -> Column:
    return guarded(x, F.stddev_samp(x), rows, least)


def z_score(x: Column, rows: int = 52, least: int = 4) -> Column:
    return (x - rolling_mean(x, rows, least)) / F.greatest(rolling_std(x, rows, least), F.lit(1e-6))


def prior_p75(x: Column, rows: int = 52, least: int = 4) -> Column:
    """The 75th percentile of the rows before this one."""
    return guarded(x, F.percentile(x, F.lit(0.75)), rows, least, last=-1)


def pct_change(x: Column) -> Column:
    """Change from the row before, in percent; 0 where that is 0 or missing, or x is missing."""
    before = F.lag(x).over(by_week())
    return F.coalesce((x - before) / F.nullif(before, F.lit(0)) * 100, F.lit(0.0))


def label(x: Column, p75: Column) -> Column:
    """1 if x is over its baseline, 0 if not or x is missing, null without a baseline."""
    return F.when(p75.isNotNull(), F.coalesce((x > p75).cast("int"), F.lit(0)))


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_week().rowsBetween(Window.unboundedPreceding, 0))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the given order, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def latest_bts(bts: DataFrame) -> DataFrame:
    """Of rows for the same port and week, the one taken in last; ties to the larger count, then to the larger median."""
    return keep_first(bts.filter("port_id IS NOT NULL AND week_ending IS NOT NULL"), ["port_id", "week_ending"], F.desc("ingested_at"), F.desc("vessel_call_count"), F.desc("median_berthing_time_hrs"))


def port_features(bts: DataFrame) -> DataFrame:
    """Lags, changes, rolling statistics, baseline, label and calendar of each (port_id, week_ending)."""
    x, calls = F.col("median_berthing_time_hrs"), F.col("vessel_call_count").cast("double")
    lag = lambda k: F.lag(x, k).over(by_week())
    week = F.col("week_ending")
    out = latest_bts(bts).select(
        "port_id", "week_ending", "median_berthing_time_hrs", "avg_berthing_time_hrs", "vessel_call_count",
        lag(1).alias("berthing_time_lag_1w"), lag(2).alias("berthing_time_lag_2w"), lag(4).alias("berthing_time_lag_4w"),
        pct_change(x).alias("berthing_time_pct_change_1w"), pct_change(calls).alias("call_count_pct_change_1w"),
        rolling_mean(x, 4, 2).alias("berthing_time_4w_avg"), rolling_std(x, 4, 2).alias("berthing_time_4w_std"),
        rolling_mean(x, 52, 4).alias("berthing_time_52w_avg"), rolling_std(x, 52, 4).alias("berthing_time_52w_std"),
        z_score(x).alias("berthing_time_z_score_52w"), prior_p75(x).alias("berthing_time_p75_52w"),
        F.weekofyear(week).alias("week_of_year"), F.month(week).alias("month"), (F.month(week) >= 10).cast("int").alias("is_q4"),
    )
    return out.withColumn("is_disruption_week", label(x, F.col("berthing_time_p75_52w")))
