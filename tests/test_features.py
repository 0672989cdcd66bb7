"""Facts about the feature operators on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.functions import scalar as s
from quaystone.operators import geo, weekly, windows
from quaystone.registry import GOLD_COLUMNS, MODEL_COLUMNS, ports

D = dt.date
DAY = dt.datetime(2024, 4, 10)


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize("day", ["2024-04-11", "2024-04-14", "2024-04-08", "2024-04-13"])
def test_week_ends_on_sunday(spark, day):
    assert value(spark, s.week_ending(F.lit(day).cast("timestamp"))) == D(2024, 4, 14)


def test_spine_is_dense(spark):
    p = ports(spark).limit(2)
    weeks = spark.createDataFrame([(D(2024, 1, 7),), (D(2024, 1, 28),)], "week_ending date")
    rows = weekly.spine(p, weeks).collect()
    assert len(rows) == 8 and all(r.week_ending.weekday() == 6 for r in rows)
    assert weekly.spine(p, weeks.limit(0)).count() == 0
    assert weekly.fallback_spine(p, "2024-01-03").count() == 208


def test_nulls_and_bad_values(spark):
    assert value(spark, s.sql_date(F.lit("20240415"))) == D(2024, 4, 15) and value(spark, s.sql_date(F.lit("invalid"))) is None
    assert value(spark, s.lenient(F.lit("x1"))) == 0.0 and value(spark, s.lenient(F.lit("2.5"))) == 2.5
    full, empty = [F.lit(1)] * 5, [F.lit(None)] * 3
    assert value(spark, s.completeness(full)) == 1.0 and value(spark, s.completeness(full[:2] + empty)) == 0.4 and value(spark, s.completeness([])) == 0.0


def test_weather(spark):
    rows = [("a0", "High Wind Warning", "Severe"), ("a1", "Hurricane Warning", "Extreme"), ("a2", "Flood Advisory", "Moderate"), ("a3", "Dense Fog Advisory", "Minor")]
    df = spark.createDataFrame([(a, "la_lb", e, v, DAY) for a, e, v in rows] + [("a4", None, "x", "y", DAY), ("a5", "la_lb", "x", "y", None)], "alert_id string, port_id string, event_type string, severity string, effective timestamp")
    r = weekly.weather_weekly(df).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.week_ending, r.alert_count, r.extreme_alert_count, r.severe_alert_count, r.max_severity_score) == (D(2024, 4, 14), 4, 1, 1, 4)
    assert r.has_hurricane_alert == r.has_high_wind_alert == r.has_flood_alert == r.has_fog_alert == 1


def test_news(spark):
    rows = [(0, "14", -5.0, 10, 4, -2.5), (1, "14", -3.0, 5, 2, -1.5), (2, "17", -2.0, 3, 1, -0.5), (3, "20", -8.0, 20, 8, -4.0), (4, "14", -1.0, 2, 1, -1.0)]
    df = spark.createDataFrame([(i, "la_lb", "20240410", c, g, m, n, t) for i, c, g, m, n, t in rows], "global_event_id long, port_id string, sql_date string, event_root_code string, goldstein_scale double, num_mentions long, num_articles long, avg_tone double")
    r = weekly.news_weekly(df).first()
    assert (r.gdelt_event_count, r.gdelt_strike_count, r.gdelt_coerce_count, r.gdelt_conflict_count) == (5, 3, 1, 1)
    assert r.gdelt_goldstein_avg < 0 and r.gdelt_goldstein_min == -8.0 and r.gdelt_weighted_disruption == 233.0


def test_quakes_and_fires(spark):
    q = spark.createDataFrame([("us1", "la_lb", 5.2, 10.0, False, DAY), ("us2", "la_lb", 4.8, 25.0, False, DAY), ("us3", "seattle", 6.1, 5.0, True, DAY)], "usgs_id string, port_id string, magnitude double, depth_km double, tsunami_flag boolean, occurred_at timestamp")
    by = {r.port_id: r for r in weekly.quake_weekly(q).collect()}
    assert (by["la_lb"].eq_count, by["la_lb"].eq_max_magnitude, by["la_lb"].eq_depth_min_km) == (2, 5.2, 10.0) and by["seattle"].eq_tsunami_flag == 1
    f = spark.createDataFrame([("la_lb", 15.0, "high", DAY), ("la_lb", 25.0, "nominal", DAY), ("la_lb", 8.0, "high", DAY)], "port_id string, frp double, confidence string, acquired_at timestamp")
    r = weekly.fire_weekly(f).first()
    assert (r.fire_count, r.fire_high_confidence_count, r.fire_max_frp, r.fire_total_frp) == (3, 2, 25.0, 48.0)


def series(spark, *ports_):
    rows = []
    for k, p in enumerate(ports_):
        for i in range(60):
            v = None if i == 30 else 35.0 if i == 50 else 20.0 + (i * 7 % 5)
            rows.append((p, D(2023, 1, 1) + dt.timedelta(weeks=i), v if v is None else v * (1 + 2 * k), v, 40 + i % 9, DAY))
    return spark.createDataFrame(rows, "port_id string, week_ending date, median_berthing_time_hrs double, avg_berthing_time_hrs double, vessel_call_count int, ingested_at timestamp")


def test_port_features_against_plain_windows(spark):
    import numpy as np
    import pandas as pd

    got = windows.port_features(series(spark, "a", "b")).orderBy("port_id", "week_ending").toPandas()
    for port, g in got.groupby("port_id"):
        x = g["median_berthing_time_hrs"].astype(float).reset_index(drop=True)
        g = g.reset_index(drop=True)
        same = lambda a, b: np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9)
        same(g["berthing_time_lag_2w"], x.shift(2))
        same(g["berthing_time_4w_avg"], x.rolling(4, min_periods=2).mean())
        same(g["berthing_time_52w_std"], x.rolling(52, min_periods=4).std())
        same(g["berthing_time_p75_52w"], x.shift(1).rolling(52, min_periods=4).quantile(0.75))
        change = (x.diff() / x.shift(1).replace(0, np.nan) * 100).fillna(0)
        same(g["berthing_time_pct_change_1w"], change)
        assert g["is_disruption_week"][50] == 1 and pd.isna(g["is_disruption_week"][0]) and g["is_disruption_week"][30] == 0
    assert set(got["is_q4"]) == {0, 1} and got["week_of_year"].between(1, 53).all()


def test_latest_version_of_a_week_counts(spark):
    rows = [("a", D(2024, 1, 7), 1.0, 1, dt.datetime(2024, 1, 8)), ("a", D(2024, 1, 7), 2.0, 1, dt.datetime(2024, 1, 9)), ("a", None, 3.0, 1, dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "port_id string, week_ending date, median_berthing_time_hrs double, vessel_call_count int, ingested_at timestamp")
    assert [r.median_berthing_time_hrs for r in windows.latest_bts(df).collect()] == [2.0]


def test_geography(spark):
    la = value(spark, s.haversine_km(F.lit(34.05), F.lit(-118.24), F.lit(40.71), F.lit(-74.01)))
    assert 3900 < la < 4000 and value(spark, s.haversine_km(*[F.lit(1.0)] * 4)) == 0
    df = spark.createDataFrame([(1, 33.73, -118.27), (2, 40.70, -74.04), (3, None, 1.0), (4, 0.0, 0.0)], "id long, lat double, lon double")
    near = {r.id: (r.port_id, r.distance_km) for r in geo.with_nearest_port(df).collect()}
    assert near[1][0] == "la_lb" and near[1][1] < 10 and near[2][0] == "ny_nj" and 3 not in near
    assert {r.id for r in geo.with_nearest_port(df, 200).collect()} == {1, 2}
    both = geo.within_radius(df.filter("id = 1"), ports(spark), 5000)
    assert both.count() > 1 and geo.first_port_wins(both, "id").first().port_id == "la_lb"
    assert {r.id for r in geo.in_box(df).collect()} == {1, 2}


def test_canonical_columns(spark):
    got = weekly.canonical(spark.createDataFrame([("la_lb", 3, 1.5)], "port_id string, alert_count long, extra double"))
    assert got.columns == GOLD_COLUMNS and dict(got.dtypes)["eq_depth_min_km"] == "double" and dict(got.dtypes)["week_ending"] == "date" and dict(got.dtypes)["fire_count"] == "int"
    assert got.first().alert_count == 3 and got.first().fire_count is None


def test_newest_rows_are_those_of_the_gold_table(spark):
    from quaystone.plans.features import gold_frame
    from quaystone.plans.scoring import newest_rows
    from quaystone.scoring.cards import latest

    sf = "/root/testdata/sf0.001"
    assert sorted(newest_rows(spark, sf).collect()) == sorted(latest(gold_frame(spark, sf)).collect())
    bts = spark.createDataFrame([("la_lb", D(2024, 1, 7), None), ("miami", D(2024, 1, 7), 3.0), ("oakland", D(2023, 1, 1), 3.0)], "port_id string, week_ending date, median_berthing_time_hrs double")
    some = spark.createDataFrame([("la_lb", DAY)], "port_id string, at timestamp")
    got = {r.port_id: r.data_completeness for r in weekly.newest(ports(spark), bts, {k: (some if k == "a" else some.limit(0), F.col("at")) for k in "abcd"}).collect()}
    assert len(got) == 10 and got["miami"] == 0.4 and got["la_lb"] == got["oakland"] == 0.2
    assert weekly.newest(ports(spark), bts.limit(0), {"a": (some, F.col("at"))}).count() == 0


def test_gold_reads_each_source_once(spark):
    """Whether a source has rows is read from the rows that are shuffled for the join."""
    from quaystone.plans.features import gold_frame

    gold = gold_frame(spark, "/root/testdata/sf0.001")
    gold.collect()
    plan = gold._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    print(plan.count("ReusedExchange"), plan.count("Exchange hashpartitioning"))
    assert plan.count("ReusedExchange") >= 4


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_percentiles_against_numpy(spark, most):
    import numpy as np

    from quaystone.operators.quantiles import percentiles

    rng = np.random.default_rng(8)
    for values in (rng.normal(size=3000), rng.integers(0, 4, 3000).astype(float), np.array([5.0]), np.full(500, 2.0), np.concatenate([np.zeros(2900), rng.normal(size=100)])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
        np.testing.assert_allclose(percentiles(df, "v", shares, most), np.quantile(values, shares), rtol=1e-12)
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5], most) == [None]


def test_column_profile(spark):
    from quaystone.plans.features import column_profile

    df = spark.createDataFrame([("b", 2, 1.5, D(2024, 1, 7)), ("a", None, 0.5, None)], "s string, i int, x double, d date")
    got = {r.column_name: tuple(r)[1:] for r in column_profile(df).collect()}
    assert got == {"s": ("text", 2, 2, None, "a"), "i": ("whole", 1, 2, 2.0, None), "x": ("real", 2, 2, 0.5, None), "d": ("date", 1, 2, None, "2024-01-07")}


def test_column_lists():
    assert len(GOLD_COLUMNS) == 48 == len(set(GOLD_COLUMNS)) and len(MODEL_COLUMNS) == 32 and set(MODEL_COLUMNS) < set(GOLD_COLUMNS)
