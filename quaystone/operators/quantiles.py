"""Exact percentiles of large columns, without all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are ranked in one task.
RANKED = 1 << 20
#: Rank error of the sketch that narrows the range, as a share of the rows, is 1 / ACCURACY.
ACCURACY = 2000


def _at_rank(values: DataFrame, ranks: list[int], n: int, most: int) -> list[float]:
    """The values at some neighbouring ranks (from 0) of a column v of n numbers. Rows outside a range that surely holds the
    ranks are only counted, until what is left is small enough to rank."""
    below = 0
    while n > most:
        margin = 2 / ACCURACY
        low, high = ((ranks[0] - below) / n - margin, (ranks[-1] - below) / n + margin)
        lo, hi = values.agg(F.percentile_approx("v", [max(0.0, low), min(1.0, high)], ACCURACY)).first()[0]
        lo, hi = (None if low <= 0 else lo), (None if high >= 1 else hi)
        if lo is not None and lo == hi:
            return [lo] * len(ranks)
        inside = (F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") <= hi)
        smaller, left = values.agg(F.count_if(F.lit(False) if lo is None else F.col("v") < lo), F.count_if(inside)).first()
        if left == n:
            break
        below, n, values = below + smaller, left, values.filter(inside)
    # Equal values are one row, so what is ranked is small even if one value fills the range.
    steps = values.groupBy("v").count().select("v", F.sum("count").over(Window.orderBy("v")).alias("upto"))
    found = steps.agg(*[F.min(F.when(F.col("upto") > r - below, F.col("v"))) for r in ranks]).first()
    return list(found)


def percentiles(df: DataFrame, column: str, shares: list[float], most: int = RANKED) -> list[float | None]:
    """Percentiles with linear interpolation between the two nearest values. Nulls and NaN don't count; without values all are None."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        place = share * (n - 1)
        low = min(int(place), n - 1)
        a, b = _at_rank(values, [low, min(low + 1, n - 1)], n, most)
        out.append(a + (b - a) * (place - low))
    return out
