"""Rolling statistics over long series, one series cut into ranges for many tasks.

A window by key puts a whole series into one task, and sorts each frame anew for a percentile. Here the rows are put in order of
(key, order) once, by ranges, and numbered from the sizes of the files; each range of a series is then worked on by itself, with
the rows before it that its first frames reach back to (its halo). A frame's percentile comes from a sorted list that slides:
one value in, one out. So a series that holds all rows spreads over as many tasks as it has ranges.

Frames count rows. Cases: a null or NaN value is a row of the frame without a value; rows of equal order are put in the order of the
tie columns, and those equal in these too in any order; a null key is a series, a null order is first; extra columns stay, but for
those named as the statistics, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.sources.lake import scratch

#: Rows of a series that are one group, at least; a group also holds its halo.
RANGE_ROWS = 20_000
STATS = {"roll_n": "bigint", "roll_mean": "double", "roll_std": "double", "roll_z": "double", "roll_prior": "double"}


def numbered(df: DataFrame, key: str, order: str, ties: list[str], name: str) -> DataFrame:
    """df with each row's place (from 0) in the series of its key, as column `name`. The sorted rows are stored, so that all places
    are those of one sort, whatever runs again."""
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/series"
    columns = list(dict.fromkeys([key, order, *ties]))
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # One row a key and file: where the key begins in the file, and how many of its rows are in the files before.
    parts = rows.groupBy(F.col(key).alias("__key"), F.col("__file").alias("__name")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    part = F.regexp_extract("__name", r"part-(\d+)", 1).cast("int")
    before = Window.partitionBy("__key").orderBy(part, "__name").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__key", "__name", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    out = rows.join(parts, (F.col("__file") == F.col("__name")) & F.col(key).eqNullSafe(F.col("__key")))
    return out.select(*df.columns, (F.col("__row") + F.col("__base")).alias(name))


def _moments(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number, mean and sum of squared differences of the values so far, anew from each start on; a row each."""
    out, n, mean, squares = np.zeros((len(x), 3)), 0, 0.0, 0.0
    for i, (value, start) in enumerate(zip(x.tolist(), starts.tolist(), strict=True)):
        if start:
            n, mean, squares = 0, 0.0, 0.0
        if value == value:
            n += 1
            off = value - mean
            mean += off / n
            squares += off * (value - mean)
        out[i] = n, mean, squares
    return out


def _frames(x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The moments of the last `rows` rows at each row. With cuts every `rows` rows, a frame is the end of one piece and the
    beginning of the next; both are summed up by themselves and put together, so nothing is ever subtracted."""
    at = np.arange(len(x))
    n, mean, squares = _moments(x, at % rows == 0).T
    ends = _moments(x[::-1], (at % rows == rows - 1)[::-1])[::-1]
    first = at - rows + 1
    reach = (first >= 0) & (first % rows != 0)
    m, other, more = np.where(reach[:, None], ends[np.maximum(first, 0)], 0.0).T
    total = n + m
    share = np.divide(m, total, out=np.zeros(len(x)), where=total > 0)
    off = np.where((n > 0) & (m > 0), other - mean, 0.0)
    return total.astype(np.int64), np.where(n > 0, mean + off * share, other), squares + more + off * off * n * share


def _quantiles(x: np.ndarray, rows: int, least: int, share: float) -> np.ndarray:
    """Of the `rows` rows before each row, interpolated between the two nearest values."""
    out, held = np.full(len(x), np.nan), []
    for i, value in enumerate(x):
        n = len(held)
        if n >= least:
            place = share * (n - 1)
            low = int(place)
            a, b = held[low], held[min(low + 1, n - 1)]
            out[i] = a + (b - a) * (place - low)
        if value == value:
            insort(held, value)
        if i >= rows and (old := x[i - rows]) == old:
            del held[bisect_left(held, old)]
    return out


def statistics(x: np.ndarray, rows: int, least: int, share: float) -> dict[str, np.ndarray]:
    """Statistics of the last `rows` rows at each row of one series; the percentile is of the rows before it."""
    n, mean, squares = _frames(x, rows)
    enough = n >= max(least, 1)
    mean = np.where(enough, mean, np.nan)
    std = np.sqrt(np.divide(squares, n - 1, out=np.full(len(x), np.nan), where=enough & (n > 1)))
    return {"roll_n": n, "roll_mean": mean, "roll_std": std, "roll_z": (x - mean) / np.maximum(std, 1e-6), "roll_prior": _quantiles(x, rows, least, share)}


def _range(names: list[str], rows: int, least: int, share: float):
    """The rows of one range with their statistics; the halo's rows go."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__place")
        found = statistics(table["__value"].to_numpy(), rows, least, share)
        out = pa.table([*[table[c] for c in names], *[pa.array(v, from_pandas=True) for v in found.values()]], [*names, *found])
        return out.filter(table["__own"])

    return run


def rolling(df: DataFrame, key: str, order: str, value: str, rows: int, least: int = 4, share: float = 0.75, ties: list[str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with statistics of `value` over the last `rows` rows of the key's series, of any length: roll_n (values in the frame),
    roll_mean, roll_std (of a sample), roll_z, and roll_prior, the percentile `share` of the rows before. Null where a frame has fewer
    than `least` values."""
    names = [c for c in df.columns if c not in STATS]
    placed = numbered(df.select(*names), key, order, ties or [], "__place")
    size = max(range_rows, rows)
    found = F.col(value).cast("double")
    # A row goes to its own range, and to the next one if frames there reach back to it: then its value only.
    spread = placed.withColumn("__range", F.explode(F.expr(f"sequence(__place div {size}, (__place + {rows}) div {size})")))
    spread = spread.withColumns({"__own": F.col("__range") == F.expr(f"__place div {size}"), "__value": F.when(~F.isnan(found), found), "__key": F.col(key)})
    sent = spread.select("__key", "__range", "__place", "__own", "__value", *[F.when(F.col("__own"), F.col(c)).alias(c) for c in names])
    schema = ", ".join([f"`{n}` {t}" for n, t in df.select(*names).dtypes] + [f"{n} {t}" for n, t in STATS.items()])
    return sent.groupBy("__key", "__range").applyInArrow(_range(names, rows, least, share), schema)
