"""Facts about scores, tiers, confidence, signals and cards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.functions import scalar as s
from quaystone.plans.features import impact_table
from quaystone.scoring import cards as c

AS_OF = "2024-05-10"
NOW = dt.datetime(2024, 5, 10)


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


@pytest.mark.parametrize(("score", "tier"), [(0, "low"), (15, "low"), (29.99, "low"), (30, "medium"), (50, "medium"), (59.99, "medium"), (60, "high"), (75, "high"), (79.99, "high"), (80, "critical"), (100, "critical")])
def test_tiers(spark, score, tier):
    assert value(spark, s.tier(F.lit(float(score)))) == tier


def test_scores(spark):
    score = lambda p, a, i: value(spark, s.risk_score(F.lit(p), F.lit(a), F.lit(i)))
    assert 45 < score(0.5, 0.5, 0.5) < 55 and score(1.0, 1.0, 1.0) > 85 and score(0.0, 0.0, 0.0) < 15
    assert score(1.0, 0.5, 0.5) - score(0.0, 0.5, 0.5) > score(0.5, 1.0, 0.5) - score(0.5, 0.0, 0.5)


@pytest.mark.parametrize(
    ("completeness", "signals", "drivers", "anomaly", "loaded", "score", "flag"),
    [(1.0, 5, 3, 0.7, True, 100, None), (1.0, 5, 3, 0.7, False, 60, "no_model_loaded"), (0.3, 5, 3, 0.7, True, 70, "low_data_completeness"), (0.6, 5, 3, 0.7, True, 85, "partial_data"), (1.0, 1, 3, 0.7, True, 90, "few_signals"), (1.0, 5, 0, 0.7, True, 90, "no_shap_drivers"), (1.0, 5, 3, 0.5, True, 95, "anomaly_default"), (0.3, 0, 0, 0.5, False, 5, "few_signals")],
)
def test_confidence(spark, completeness, signals, drivers, anomaly, loaded, score, flag):
    got, flags = c.confidence(*[F.lit(x) for x in (completeness, signals, drivers, anomaly, loaded)])
    r = spark.range(1).select(got.alias("s"), flags.alias("f")).first()
    assert r.s == score and (any(x.startswith(flag) for x in r.f) if flag else r.f == [])


def test_clamps(spark):
    clamp = lambda x, lo, hi, n: value(spark, s.clamp(F.lit(x), lo, hi, n))
    assert clamp(150.0, 0, 100, 2) == 100 and clamp(-10.0, 0, 100, 2) == 0 and clamp(1.5, 0, 1, 4) == 1 and clamp(-0.2, 0, 1, 4) == 0


def found(spark):
    alerts = spark.createDataFrame([("1", "la_lb", "Wind", "severe", "windy", NOW), ("2", "la_lb", "Fog", "minor", None, NOW - dt.timedelta(days=30)), ("3", "ny_nj", "Fog", "odd", None, NOW)], "alert_id string, port_id string, event_type string, severity string, headline string, effective timestamp_ntz")
    quakes = spark.createDataFrame([("q", "la_lb", 7.5, "sea", 12.3456, True, NOW - dt.timedelta(hours=3))], "usgs_id string, port_id string, magnitude double, place string, distance_km double, tsunami_flag boolean, occurred_at timestamp_ntz")
    news = spark.createDataFrame([(i, "la_lb", "20240509", "145", -7.0 + i, "" if i % 2 else "Pier") for i in range(25)], "global_event_id long, port_id string, sql_date string, event_code string, goldstein_scale double, action_geo_name string")
    fires = spark.createDataFrame([(1, "la_lb", 34.1, -118.1, 15.4, "high", 60.0, NOW), (2, "la_lb", 34.1, -118.1, 0.0, "low", 60.0, NOW)], "event_id long, port_id string, lat double, lon double, frp double, confidence string, distance_km double, acquired_at timestamp_ntz")
    return c.all_signals(c.weather_signals(alerts, AS_OF, 7), c.news_signals(news, AS_OF, 7), c.quake_signals(quakes, AS_OF, 7), c.fire_signals(fires, AS_OF, 7))


def test_signals(spark):
    rows = {r.signal_id: r for r in found(spark).collect()}
    assert rows["nws-1"].severity == "high" and rows["nws-1"].description == "Wind: windy" and "nws-2" not in rows and rows["nws-3"].severity == "low" and rows["nws-3"].description == "Fog: Fog"
    assert rows["usgs-q"].severity == "critical" and rows["usgs-q"].description == "M7.5 earthquake near sea (12.35 km from port) — TSUNAMI WARNING"
    assert sum(k.startswith("gdelt") for k in rows) == 20 and rows["gdelt-1"].description == "GDELT event 145 near unknown location (Goldstein: -6.0)"
    assert (rows["gdelt-0"].severity, rows["gdelt-3"].severity, rows["gdelt-6"].severity, rows["gdelt-7"].severity) == ("critical", "high", "medium", "low")
    assert rows["firms-1"].description.endswith(", FRP=15 MW") and not rows["firms-2"].description.endswith("MW") and rows["firms-1"].severity == "high"


def test_cards_without_model(spark):
    gold = spark.createDataFrame([("la_lb", dt.date(2024, 5, 5), 0.6), ("la_lb", dt.date(2024, 4, 28), 1.0)], "port_id string, week_ending date, data_completeness_score double")
    cards = {r.port_id: r for r in c.cards(impact_table(spark), c.latest(gold), found(spark)).collect()}
    assert len(cards) == 10
    la, sea = cards["la_lb"], cards["seattle"]
    assert la.impact_index == 1.0 and la.data_completeness == 0.6 and la.n_signals == 24 and la.confidence_score == 30 and sea.data_completeness == 0.0 and sea.n_signals == 0
    assert la.risk_score == max(x.risk_score for x in cards.values()) and len(la.recommended_actions) in (3, 4, 5)


def test_what_if(spark):
    i = impact_table(spark)
    base = i.select("port_id", s.risk_score(F.lit(0.5), F.lit(0.5), F.col("impact_index")).alias("risk_score"))
    sc = spark.createDataFrame([(1, "la_lb", 0.9, None), (2, "la_lb", 0.1, 0.1), (3, "nowhere", 0.5, 0.5)], "scenario_id long, port_id string, p_disruption double, anomaly_score double")
    got = {r.scenario_id: r for r in c.simulate(sc, i, base).collect()}
    assert set(got) == {1, 2} and got[1].risk_score > 50 > got[2].risk_score and got[1].delta_score > 0 > got[2].delta_score


def test_evidence_packs_come_in_parts(spark):
    import json

    from quaystone.plans.scoring import evidence_packs

    few = found(spark)
    many = spark.range(3000).selectExpr("concat('x', id) AS signal_id", "'nws' AS source", "'weather_alert' AS signal_type", "'d' AS description", "'low' AS severity", "'miami' AS port_id", "timestamp_ntz'2024-05-09 00:00:00' AS observed_at", "cast(id % 3 AS int) AS severity_order")
    signals = few.unionByName(many.select(*[F.col(c).cast(t) for c, t in few.dtypes]))
    gold = spark.createDataFrame([], "port_id string, week_ending date, data_completeness_score double")
    cards = c.cards(impact_table(spark), c.latest(gold), signals)
    rows = evidence_packs(cards, signals).collect()
    packs = {(r.port_id, r.part): json.loads(r.pack)["active_signals"] for r in rows}
    miami = [packs[("miami", i)] for i in range(1, 7)]
    assert len(rows) == len(packs) == 15 and {(r.n_signals, r.parts) for r in rows if r.port_id == "miami"} == {(3000, 6)}
    assert sorted(x["signal_id"] for p in miami for x in p) == sorted(f"x{i}" for i in range(3000)) and max(map(len, miami)) < 700
    severity = [x["o"] for p in miami for x in p]
    assert severity == sorted(severity)
    assert [len(packs[(p, 1)]) for p in ("la_lb", "ny_nj", "seattle")] == [24, 1, 0]
    top = max(r.risk_score for r in rows)
    assert {r.max_risk for r in rows} == {top} and {r.port_id for r in rows if r.is_empty} == {r.port_id for r in rows} - {"la_lb", "ny_nj", "miami"}
    overview = json.loads(rows[0].pack)["overview"]
    assert [x["risk_score"] for x in overview] == sorted((x["risk_score"] for x in overview), reverse=True) and len(overview) == 10
    some = evidence_packs(cards, signals, ["seattle", "atlantis", "ny_nj"]).collect()
    assert sorted(r.port_id for r in some) == ["ny_nj", "seattle"] and len(json.loads(some[0].pack)["overview"]) == 2
    assert some[0].max_risk == max(r.risk_score for r in some) and evidence_packs(cards, signals, []).count() == 0 and len(evidence_packs(cards, signals).collect()) == 15
    assert evidence_packs(cards, signals, ["atlantis"]).count() == 0


def test_choices_and_caps(spark):
    gold = spark.createDataFrame([], "port_id string, week_ending date, data_completeness_score double")
    signals = found(spark)
    cards = c.cards(impact_table(spark), c.latest(gold), signals)
    down, up = c.ranked(cards).collect(), c.ranked(cards, "n_signals", ascending=True).collect()
    assert [r.risk_score for r in down] == sorted((r.risk_score for r in down), reverse=True) and [r.place for r in down] == list(range(1, 11))
    assert [r.n_signals for r in up] == sorted(r.n_signals for r in up) and up[-1].port_id == "la_lb"
    with pytest.raises(ValueError):
        c.ranked(cards, "colour")
    shown = [r for r in c.shown_signals(signals).collect() if r.port_id == "la_lb"]
    shown.sort(key=lambda r: r.place)
    assert [r.place for r in shown] == list(range(1, 13)) and [r.severity_order for r in shown] == sorted((r.severity_order for r in shown), reverse=True)
    assert (shown[0].signal_id, shown[0].severity) == ("usgs-q", "critical")
    long = c.port_signals(signals, "la_lb", AS_OF, 500).collect()
    short = c.port_signals(signals, "la_lb", AS_OF, 0).collect()
    assert {r.n for r in long} == {24} == {len(long)} and {r.n for r in short} == {len(short)} and c.port_signals(signals, "atlantis", AS_OF, 7).count() == 0
    some = F.array(*[F.struct(F.lit(f"f{i}").alias("feature"), F.lit(float((-1) ** i * i)).alias("impact")) for i in range(12)])
    assert [x.feature for x in value(spark, c.shown_drivers(some))] == [f"f{i}" for i in range(11, 3, -1)]
