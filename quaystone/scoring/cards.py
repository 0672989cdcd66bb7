"""Signals, confidence, risk cards, rankings and what-if scores, each one job for all ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import scalar as s
from quaystone.registry import ACTIONS, CONFIDENCE_FLAGS, DEFAULT_IMPACT, SEVERITY_ORDER, SIGNAL_SEVERITY

SIGNAL = ["signal_id", "source", "signal_type", "description", "severity", "port_id", "observed_at"]
NEWS_CAP, MAX_TEXT = 20, 200
DRIVERS = "array<struct<feature:string,value:double,impact:double,direction:string>>"
MODEL_INFO = "struct<version:string,cv_pr_auc:double,n_train_rows:bigint>"
#: Signals of one part of a card or pack, about; a port with more has several parts.
PART_SIGNALS = 500


def recent(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last days up to as_of and later; rows without a time go."""
    return df.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAY"))


def _signal(df: DataFrame, source: str, kind: str, key: Column, text: Column, severity: Column, at: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{source}-"), key.cast("string")).alias("signal_id"), F.lit(source).alias("source"), F.lit(kind).alias("signal_type"), F.substring(text, 1, MAX_TEXT).alias("description"),
        severity.alias("severity"), "port_id", at.cast("timestamp_ntz").alias("observed_at"),
    )


def weather_signals(alerts: DataFrame, as_of: str, days: int) -> DataFrame:
    kind = F.coalesce("event_type", F.lit("Weather Alert"))
    text = F.concat(kind, F.lit(": "), F.coalesce("headline", kind))
    return _signal(recent(alerts, "effective", as_of, days), "nws", "weather_alert", F.col("alert_id"), text, s.lookup(F.lower("severity"), SIGNAL_SEVERITY, "low"), F.col("effective"))


def news_signals(news: DataFrame, as_of: str, days: int) -> DataFrame:
    """At most NEWS_CAP a port, the newest first (the cap is the feature)."""
    dated = news.withColumn("observed", s.sql_date(F.col("sql_date")).cast("timestamp_ntz"))
    rank = F.row_number().over(Window.partitionBy("port_id").orderBy(F.desc("observed"), "global_event_id"))
    kept = recent(dated, "observed", as_of, days).withColumn("__rank", rank).filter(F.col("__rank") <= NEWS_CAP)
    place = F.coalesce(F.nullif("action_geo_name", F.lit("")), F.lit("unknown location"))
    text = F.format_string("GDELT event %s near %s (Goldstein: %+.1f)", "event_code", place, "goldstein_scale")
    return _signal(kept, "gdelt", "supply_chain_news", F.col("global_event_id"), text, s.ladder(F.col("goldstein_scale"), [(-7.0, "critical"), (-4.0, "high"), (-1.0, "medium")], "low", below=True), F.col("observed"))


def quake_signals(quakes: DataFrame, as_of: str, days: int) -> DataFrame:
    text = F.format_string("M%.1f earthquake near %s (%.2f km from port)", "magnitude", F.coalesce("place", F.lit("unknown location")), "distance_km")
    text = F.concat(text, F.when(F.col("tsunami_flag"), " — TSUNAMI WARNING").otherwise(""))
    return _signal(recent(quakes, "occurred_at", as_of, days), "usgs", "earthquake", F.col("usgs_id"), text, s.ladder(F.col("magnitude"), [(7.0, "critical"), (6.0, "high"), (5.0, "medium")], "low"), F.col("occurred_at"))


def fire_signals(fires: DataFrame, as_of: str, days: int) -> DataFrame:
    text = F.format_string("Fire detection at (%.2f, %.2f), %.2f km from port", "lat", "lon", "distance_km")
    text = F.concat(text, F.when(F.coalesce("frp", F.lit(0.0)) != 0, F.format_string(", FRP=%s MW", F.bround("frp", 0).cast("long"))).otherwise(""))
    severity = s.lookup(F.col("confidence"), {"high": "high", "nominal": "medium"}, "low")
    return _signal(recent(fires, "acquired_at", as_of, days), "firms", "fire", F.col("event_id"), text, severity, F.col("acquired_at"))


def all_signals(*kinds: DataFrame) -> DataFrame:
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("severity_order", s.lookup(F.col("severity"), SEVERITY_ORDER, 0))


def confidence(completeness: Column, n_signals: Column, n_drivers: Column, anomaly: Column, loaded: Column) -> tuple[Column, Column]:
    """Score from 0 to 100, and the flags that lowered it, in order."""
    share = F.concat(F.bround(completeness * 100, 0).cast("int").cast("string"), F.lit("%"))
    low, partial = completeness < 0.5, (completeness >= 0.5) & (completeness < 0.75)
    neutral = F.abs(anomaly - 0.5) < 1e-6
    said = lambda name: F.replace(F.lit(CONFIDENCE_FLAGS[name]), F.lit("{share}"), share) if "{share}" in CONFIDENCE_FLAGS[name] else F.lit(CONFIDENCE_FLAGS[name])
    tests = [(~loaded, 40, "no_model"), (low, 30, "low"), (partial, 15, "partial"), (n_signals < 2, 10, "few"), (n_drivers == 0, 10, "no_drivers"), (neutral, 5, "neutral")]
    score = F.lit(100.0)
    for test, cost, _ in tests:
        score = score - F.when(test, float(cost)).otherwise(0.0)
    return F.greatest(F.lit(0.0), score), F.filter(F.array(*[F.when(t, said(f)) for t, _, f in tests]), lambda x: x.isNotNull())


def actions(tier: Column) -> Column:
    out = None
    for name, texts in ACTIONS.items():
        value = F.array(*[F.lit(t) for t in texts])
        out = F.when(tier == name, value) if out is None else out.when(tier == name, value)
    return out


def latest(gold: DataFrame) -> DataFrame:
    """The newest row of each port: its week and completeness."""
    return gold.groupBy("port_id").agg(F.max("week_ending").alias("features_week_ending"), F.max_by("data_completeness_score", "week_ending").alias("data_completeness"))


def cards(impact: DataFrame, newest: DataFrame, signals: DataFrame, predictions: DataFrame | None = None, horizon: int = 7, generated_at: str | None = None) -> DataFrame:
    """One card a port. newest (port_id, features_week_ending, data_completeness): the newest gold row of each port, as latest()
    gives it; predictions (port_id, p_disruption, anomaly_score, drivers, model_info); without them neutral priors of 0.5.
    generated_at: now by default. card_id follows from the port, its week, the horizon and generated_at. with_signals() adds the
    signals themselves."""
    counts = signals.groupBy("port_id").agg(F.count("*").cast("int").alias("n_signals"))
    out = impact.join(newest, "port_id", "left").join(counts, "port_id", "left")
    out = out.withColumns({"n_signals": F.coalesce("n_signals", F.lit(0)), "data_completeness": F.coalesce("data_completeness", F.when(F.col("features_week_ending").isNotNull(), F.lit(0.5)).otherwise(0.0))})
    none, no_model = F.array().cast(DRIVERS), F.lit(None).cast(MODEL_INFO)
    if predictions is None:
        out = out.withColumns({"p_disruption": F.lit(0.5), "anomaly_score": F.lit(0.5), "drivers": none, "model_info": no_model, "model_loaded": F.lit(False)})
    else:
        predictions = predictions if "model_info" in predictions.columns else predictions.withColumn("model_info", no_model)
        out = out.join(predictions.withColumn("model_loaded", F.lit(True)), "port_id", "left")
        out = out.withColumns({"model_loaded": F.coalesce("model_loaded", F.lit(False)), "p_disruption": F.coalesce("p_disruption", F.lit(0.5)), "anomaly_score": F.coalesce("anomaly_score", F.lit(0.5)), "drivers": F.coalesce(F.col("drivers").cast(DRIVERS), none)})
    score = s.risk_score(F.col("p_disruption"), F.col("anomaly_score"), F.col("impact_index"))
    sure, flags = confidence(F.col("data_completeness"), F.col("n_signals"), F.size("drivers"), F.col("anomaly_score"), F.col("model_loaded"))
    out = out.withColumns({"risk_score": s.clamp(score, 0, 100, 2), "confidence_score": s.clamp(sure, 0, 100, 2), "confidence_flags": flags})
    out = out.withColumn("risk_tier", s.tier(F.col("risk_score")))
    unit = {c: s.clamp(F.col(c), 0, 1, 4) for c in ("p_disruption", "anomaly_score", "impact_index", "data_completeness")}
    at = F.localtimestamp() if generated_at is None else F.lit(generated_at).cast("timestamp_ntz")
    made = {"recommended_actions": actions(F.col("risk_tier")), "forecast_horizon_days": F.lit(horizon), "generated_at": at}
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return out.withColumns(unit | made).withColumn("card_id", F.md5(F.concat_ws(":", "port_id", text(F.col("features_week_ending")), F.lit(str(horizon)), text(F.col("generated_at")))))


def signal_parts(signals: DataFrame, most: int = PART_SIGNALS) -> DataFrame:
    """The signals of each port, severest first, in parts of about `most`: port_id, part, parts, n_signals (all of the port),
    active_signals. The severest are in the first parts."""
    counts = signals.groupBy("port_id", "severity_order").agg(F.count("*").alias("n"))
    port = Window.partitionBy("port_id")
    chunks = F.ceil(F.col("n") / most)
    # One row for each port and severity: how many parts it takes, and how many come before.
    sizes = counts.select("port_id", "severity_order", F.sum("n").over(port).alias("n_signals"), chunks.alias("chunks"), F.sum(chunks).over(port).alias("all"), F.sum(chunks).over(port.orderBy(F.desc("severity_order"))).alias("upto"))
    one = F.col("n_signals") <= most
    sizes = sizes.select("port_id", "severity_order", "n_signals", F.when(one, 1).otherwise(F.col("all")).alias("parts"), F.when(one, 1).otherwise(F.col("chunks")).alias("chunks"), F.when(one, 0).otherwise(F.col("upto") - F.col("chunks")).alias("before"))
    order = F.struct((-F.col("severity_order")).alias("o"), F.col("signal_id").alias("signal_id"), F.col("source"), F.col("severity"), F.col("description"), F.col("observed_at"))
    part = (F.col("before") + F.pmod(F.xxhash64(order), F.col("chunks")) + 1).cast("int")
    placed = signals.join(sizes, ["port_id", "severity_order"]).withColumn("part", part)
    return placed.groupBy("port_id", "part").agg(F.sort_array(F.collect_list(order)).alias("active_signals"), F.max("n_signals").cast("int").alias("n_signals"), F.max("parts").cast("int").alias("parts"))


def with_signals(cards: DataFrame, signals: DataFrame) -> DataFrame:
    """cards with active_signals, in as many parts as signal_parts() makes; a port without signals has one part with none."""
    out = cards.drop("n_signals").join(signal_parts(signals), "port_id", "left")
    return out.withColumns({"active_signals": F.coalesce("active_signals", F.array()), "n_signals": F.coalesce("n_signals", F.lit(0)), "part": F.coalesce("part", F.lit(1)), "parts": F.coalesce("parts", F.lit(1))})


def ranked(cards: DataFrame, by: str = "risk_score", ascending: bool = False) -> DataFrame:
    """cards with place, ordered by a column the user chose; ties in registry order."""
    if by not in cards.columns:
        raise ValueError(f"no column {by!r} to sort by")
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return cards.withColumn("place", F.row_number().over(Window.orderBy(first, "ord"))).orderBy("place")  # ten ports


def port_signals(signals: DataFrame, port_id: str, as_of: str, days: int) -> DataFrame:
    """The active signals of one port over the last days, from 1 to 90, with their number."""
    own = recent(signals.filter(F.col("port_id") == port_id), "observed_at", as_of, max(1, min(int(days), 90)))
    return own.crossJoin(F.broadcast(own.agg(F.count("*").alias("n"))))  # one row


def shown_signals(signals: DataFrame, most: int = 12) -> DataFrame:
    """The signals that a port's page shows: the severest, then newest (the cap is the feature)."""
    rank = F.row_number().over(Window.partitionBy("port_id").orderBy(F.desc("severity_order"), F.desc("observed_at"), "signal_id"))
    return signals.withColumn("place", rank).filter(F.col("place") <= most)


def shown_drivers(drivers: Column, most: int = 8) -> Column:
    """The drivers that a chart shows: the largest by size."""
    bigger = lambda x, y: F.when(F.abs(x["impact"]) > F.abs(y["impact"]), -1).when(F.abs(x["impact"]) < F.abs(y["impact"]), 1).otherwise(0)
    return F.slice(F.array_sort(drivers, bigger), 1, most)


def simulate(scenarios: DataFrame, impact: DataFrame, baseline: DataFrame) -> DataFrame:
    """scenarios (scenario_id, port_id, p_disruption, anomaly_score or null) to score, tier, change to the baseline and actions."""
    known = scenarios.join(F.broadcast(impact.select("port_id", "impact_index")), "port_id").join(F.broadcast(baseline.select("port_id", F.col("risk_score").alias("baseline_score"))), "port_id", "left")
    anomaly = F.coalesce("anomaly_score", F.lit(0.5))
    neutral = s.risk_score(F.lit(0.5), F.lit(0.5), F.col("impact_index"))
    out = known.withColumns({"risk_score": s.risk_score(F.col("p_disruption"), anomaly, F.col("impact_index")), "baseline_score": F.coalesce("baseline_score", neutral)})
    out = out.withColumns({"risk_tier": s.tier(F.col("risk_score")), "delta_score": F.round(F.col("risk_score") - F.col("baseline_score"), 2)})
    return out.withColumn("recommended_actions", actions(F.col("risk_tier")))


def default_impact(index: Column) -> Column:
    return F.coalesce(index, F.lit(DEFAULT_IMPACT))
