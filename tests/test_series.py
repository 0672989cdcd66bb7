"""Rolling statistics of long series in ranges, against pandas over whole series."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators.series import numbered, rolling, statistics

SCHEMA = "k string, t int, u int, v double, more string, roll_n string"


def rows_of(n, seed=5, hot=0.7):
    rng = random.Random(seed)
    keys = ["b", "c", None]
    value = lambda: rng.choice([None, float("nan"), 7.0, 7.0, rng.gauss(1e6, 3)])
    return [("hot" if rng.random() < hot else rng.choice(keys), rng.choice([None, *range(n // 3)]), i, value(), f"m{i}" if i % 3 else None, "old") for i in range(n)]


def expected(rows, size, least, share):
    """u to (n, mean, std, z, prior) by pandas, one series a key."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        x = pd.Series([np.nan if r[3] is None else r[3] for r in own], dtype=float)
        roll = x.rolling(size, min_periods=1)
        n, before = roll.count(), x.shift().rolling(size, min_periods=least)
        mean = pd.Series([x[max(0, i - size + 1) : i + 1].mean() for i in range(len(x))]).where(n >= least)
        std = pd.Series([x[max(0, i - size + 1) : i + 1].std() for i in range(len(x))]).where(n >= least)
        z = (x - mean) / std.clip(lower=1e-6)
        for r, *v in zip(own, n, mean, std, z, before.quantile(share), strict=True):
            out[r[2]] = v
    return out


@pytest.mark.parametrize("size, ranges, least, share", [(5, 50, 2, 0.75), (40, 1, 4, 0.5), (300, 100, 4, 0.9)])
def test_against_pandas(spark, size, ranges, least, share):
    rows = rows_of(900)
    got = rolling(spark.createDataFrame(rows, SCHEMA).repartition(7), "k", "t", "v", size, least, share, ["u"], ranges)
    assert got.columns == ["k", "t", "u", "v", "more", "roll_n", "roll_mean", "roll_std", "roll_z", "roll_prior"]
    got, want = got.collect(), expected(rows, size, least, share)
    assert sorted(r.u for r in got) == list(range(900))
    assert {r.u: (r.k, r.t, r.more) for r in got} == {r[2]: (r[0], r[1], r[4]) for r in rows}
    for r in got:
        for mine, other in zip((r.roll_n, r.roll_mean, r.roll_std, r.roll_z, r.roll_prior), want[r.u], strict=True):
            assert mine is None if np.isnan(other) else mine == pytest.approx(other, rel=1e-6, abs=1e-6)


def test_one_hot_series_in_many_tasks(spark):
    df = spark.range(60_000).select(F.lit("p").alias("k"), F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("t"), ((F.col("id") * 37) % 1000).cast("double").alias("v"))
    got = rolling(df, "k", "t", "v", 5000, range_rows=6000).toPandas().sort_values("t")
    x = got["v"].reset_index(drop=True)
    assert np.allclose(got["roll_prior"].to_numpy(), x.shift().rolling(5000, min_periods=4).quantile(0.75).to_numpy(), equal_nan=True)
    assert np.allclose(got["roll_mean"].to_numpy(), x.rolling(5000, min_periods=4).mean().to_numpy(), equal_nan=True)


def test_places_are_those_of_one_sort(spark):
    rows = rows_of(500, seed=8, hot=0.5)
    got = numbered(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", "t", ["u"], "place").collect()
    for key in ("hot", "b", "c", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert [(r.t is not None, r.t or 0, r.u) for r in own] == sorted((r.t is not None, r.t or 0, r.u) for r in own)


def test_equal_values_have_no_spread_and_empty_tables(spark):
    x = np.array([0.1] * 50 + [np.nan] * 3 + [0.3] * 50)
    found = statistics(x, 10, 2, 0.75)
    assert found["roll_std"][20] == 0 and found["roll_mean"][20] == 0.1 and found["roll_std"][-1] == 0 and found["roll_std"][54] > 0.05
    assert rolling(spark.createDataFrame([], SCHEMA), "k", "t", "v", 10).collect() == []
