"""Signals, cards, rankings, packs and what-if scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.adapters import AS_OF, sql
from quaystone.functions import scalar as s
from quaystone.operators import weekly
from quaystone.plans.features import GOLD_PARTS, GOLD_VIEWS, SQL_IMPACT, impact_table
from quaystone.plans.registry import query
from quaystone.registry import ACTIONS, CONFIDENCE_FLAGS, SORTED_IDS, ports
from quaystone.scoring import cards as c

DAYS = 7


def _kinds(spark, sf_dir, days: int = DAYS) -> list[DataFrame]:
    alerts = a.a_nws(spark, sf_dir).withColumn("headline", F.when(F.col("event_id") % 3 != 0, F.concat(F.col("severity"), F.lit(" conditions near "), F.col("port_id"))))
    news = a.a_gdelt(spark, sf_dir).withColumn("action_geo_name", F.when(F.col("global_event_id") % 4 != 0, F.concat(F.lit("district "), (F.col("global_event_id") % 9).cast("string"))))
    quakes = a.a_usgs(spark, sf_dir).withColumn("place", F.concat(F.lit("zone "), (F.col("event_id") % 12).cast("string")))
    return [c.weather_signals(alerts, AS_OF, days), c.news_signals(news, AS_OF, 120), c.quake_signals(quakes, AS_OF, days), c.fire_signals(a.a_firms(spark, sf_dir), AS_OF, days)]


def _since(column: str, days: int) -> str:
    return f"{column} >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


_S_NWS = f"""SELECT 'nws-' || alert_id AS signal_id, 'nws' AS source, 'weather_alert' AS signal_type, left(event_type || ': ' || CASE WHEN event_id % 3 <> 0 THEN severity || ' conditions near ' || port_id ELSE event_type END, 200) AS description,
    CASE lower(severity) WHEN 'extreme' THEN 'critical' WHEN 'severe' THEN 'high' WHEN 'moderate' THEN 'medium' ELSE 'low' END AS severity, port_id, effective AS observed_at FROM a_nws WHERE {_since('effective', DAYS)}"""
_S_NEWS = f"""SELECT 'gdelt-' || global_event_id AS signal_id, 'gdelt' AS source, 'supply_chain_news' AS signal_type, left('GDELT event ' || event_code || ' near ' || CASE WHEN global_event_id % 4 <> 0 THEN 'district ' || (global_event_id % 9) ELSE 'unknown location' END || ' (Goldstein: ' || printf('%+.1f', goldstein_scale) || ')', 200) AS description,
    CASE WHEN goldstein_scale <= -7 THEN 'critical' WHEN goldstein_scale <= -4 THEN 'high' WHEN goldstein_scale <= -1 THEN 'medium' ELSE 'low' END AS severity, port_id, observed AS observed_at
    FROM (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY observed DESC, global_event_id) AS rk FROM (SELECT *, strptime(sql_date, '%Y%m%d') AS observed FROM a_gdelt) WHERE {_since('observed', 120)}) WHERE rk <= 20"""
_S_QUAKE = f"""SELECT 'usgs-' || usgs_id AS signal_id, 'usgs' AS source, 'earthquake' AS signal_type, left('M' || printf('%.1f', magnitude) || ' earthquake near zone ' || (event_id % 12) || ' (' || printf('%.2f', distance_km) || ' km from port)' || CASE WHEN tsunami_flag THEN ' — TSUNAMI WARNING' ELSE '' END, 200) AS description,
    CASE WHEN magnitude >= 7 THEN 'critical' WHEN magnitude >= 6 THEN 'high' WHEN magnitude >= 5 THEN 'medium' ELSE 'low' END AS severity, port_id, occurred_at AS observed_at FROM a_usgs WHERE {_since('occurred_at', DAYS)}"""
_S_FIRE = f"""SELECT 'firms-' || event_id AS signal_id, 'firms' AS source, 'fire' AS signal_type, left('Fire detection at (' || printf('%.2f', lat) || ', ' || printf('%.2f', lon) || '), ' || printf('%.2f', distance_km) || ' km from port' || CASE WHEN coalesce(frp, 0) <> 0 THEN ', FRP=' || round_even(frp, 0)::BIGINT || ' MW' ELSE '' END, 200) AS description,
    CASE confidence WHEN 'high' THEN 'high' WHEN 'nominal' THEN 'medium' ELSE 'low' END AS severity, port_id, acquired_at AS observed_at FROM a_firms WHERE {_since('acquired_at', DAYS)}"""
_ORDER = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_S_ALL = f"SELECT *, {_ORDER} AS severity_order FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"
_SIGNAL_VIEWS = ("a_nws", "a_gdelt", "a_usgs", "a_firms")
_SIGNAL_PARTS = {"s1": _S_NWS, "s2": _S_NEWS, "s3": _S_QUAKE, "s4": _S_FIRE, "s_all": _S_ALL}


def signal_sql(body: str, **more: str) -> str:
    return sql(body, *_SIGNAL_VIEWS, **(_SIGNAL_PARTS | more))


def signals(spark, sf_dir, days: int = DAYS) -> DataFrame:
    return c.all_signals(*_kinds(spark, sf_dir, days))


@query("sc_signals_weather", sql(_S_NWS, "a_nws"))
def sc_signals_weather(spark, sf_dir):
    return _kinds(spark, sf_dir)[0]


@query("sc_signals_news", sql(_S_NEWS, "a_gdelt"))
def sc_signals_news(spark, sf_dir):
    return _kinds(spark, sf_dir)[1]


@query("sc_signals_quake", sql(_S_QUAKE, "a_usgs"))
def sc_signals_quake(spark, sf_dir):
    return _kinds(spark, sf_dir)[2]


@query("sc_signals_fire", sql(_S_FIRE, "a_firms"))
def sc_signals_fire(spark, sf_dir):
    return _kinds(spark, sf_dir)[3]


@query("sc_signals_all", signal_sql("SELECT * FROM s_all"))
def sc_signals_all(spark, sf_dir):
    """Severest first, then newest."""
    return signals(spark, sf_dir).orderBy(F.desc("severity_order"), F.desc("observed_at"), "signal_id")


@query("sc_signal_counts", signal_sql("SELECT port_id, source, count(*) AS n FROM s_all GROUP BY ALL"))
def sc_signal_counts(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("port_id", "source").agg(F.count("*").alias("n"))


ALERT_PORT, ALERT_DAYS = "miami", 21
_S_LONG = {k: v.replace(f"INTERVAL {DAYS} DAY", f"INTERVAL {ALERT_DAYS} DAY") for k, v in _SIGNAL_PARTS.items()}


@query("sc_port_alerts", sql(f"SELECT port_id, signal_id, severity, observed_at, count(*) OVER () AS n FROM s_all WHERE port_id = '{ALERT_PORT}' AND {_since('observed_at', ALERT_DAYS)}", *_SIGNAL_VIEWS, **_S_LONG))
def sc_port_alerts(spark, sf_dir, port_id: str = ALERT_PORT, days: int = ALERT_DAYS):
    """The active signals of one port over some days, with their number."""
    return c.port_signals(signals(spark, sf_dir, days), port_id, AS_OF, days).select("port_id", "signal_id", "severity", "observed_at", "n")


@query("sc_shown_signals", signal_sql("SELECT port_id, signal_id, severity, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY severity_order DESC, observed_at DESC, signal_id) AS place FROM s_all) WHERE place <= 12"))
def sc_shown_signals(spark, sf_dir):
    """The first twelve signals of each port (the cap is the feature)."""
    return c.shown_signals(signals(spark, sf_dir)).select("port_id", "signal_id", "severity", "place")


_PRED = "(n_chars % 1000)::DOUBLE / 1000"
_SCORE_IN = f"SELECT doc_id, {_PRED} AS p, (doc_id % 101)::DOUBLE / 100 AS an, (doc_id % 21)::DOUBLE / 20 AS im FROM documents"


def _sql_score(p: str, an: str, im: str) -> str:
    return f"round(100.0::DOUBLE / (1.0 + exp(-(0.5::DOUBLE * ({p} - 0.5) * 4 + 0.3::DOUBLE * ({an} - 0.5) * 4 + 0.2::DOUBLE * ({im} - 0.5) * 4))), 2)"


def _sql_tier(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'critical' WHEN {x} >= 60 THEN 'high' WHEN {x} >= 30 THEN 'medium' ELSE 'low' END"


def _sql_actions(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN [{', '.join(chr(39) + x + chr(39) for x in v)}]" for k, v in ACTIONS.items()) + " END"


def _score_inputs(spark, sf_dir) -> DataFrame:
    d = a.table(spark, sf_dir, "documents")
    return d.select("doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"), ((F.col("doc_id") % 101).cast("double") / 100).alias("an"), ((F.col("doc_id") % 21).cast("double") / 20).alias("im"))


@query("sc_risk_score", f"SELECT doc_id, {_sql_score('p', 'an', 'im')} AS risk_score FROM ({_SCORE_IN})")
def sc_risk_score(spark, sf_dir):
    return _score_inputs(spark, sf_dir).select("doc_id", s.risk_score(F.col("p"), F.col("an"), F.col("im")).alias("risk_score"))


@query("sc_tier", f"SELECT event_id, {_sql_tier('value')} AS risk_tier FROM events")
def sc_tier(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", s.tier(F.col("value")).alias("risk_tier"))


@query("sc_actions", f"SELECT risk_tier, n, {_sql_actions('risk_tier')} AS recommended_actions FROM (SELECT {_sql_tier('value')} AS risk_tier, count(*) AS n FROM events GROUP BY 1)")
def sc_actions(spark, sf_dir):
    tiers = a.table(spark, sf_dir, "events").groupBy(s.tier(F.col("value")).alias("risk_tier")).agg(F.count("*").alias("n"))
    return tiers.withColumn("recommended_actions", c.actions(F.col("risk_tier")))


def _sql_confidence(dc: str, ns: str, nd: str, an: str, loaded: str) -> tuple[str, str]:
    share = f"(round_even({dc} * 100, 0)::INTEGER || '%')"
    said = {k: f"replace('{v}', '{{share}}', {share})" for k, v in CONFIDENCE_FLAGS.items()}
    tests = [
        (f"NOT {loaded}", 40, said["no_model"]), (f"{dc} < 0.5", 30, said["low"]), (f"{dc} >= 0.5 AND {dc} < 0.75", 15, said["partial"]),
        (f"{ns} < 2", 10, said["few"]), (f"{nd} = 0", 10, said["no_drivers"]), (f"abs({an} - 0.5) < 1e-6", 5, said["neutral"]),
    ]
    score = f"greatest(0.0, 100.0 - {' - '.join(f'CASE WHEN {t} THEN {k} ELSE 0 END' for t, k, _ in tests)})::DOUBLE"
    return score, f"list_filter([{', '.join(f'CASE WHEN {t} THEN {f} END' for t, _, f in tests)}], lambda x: x IS NOT NULL)"


_CONF = _sql_confidence("dc", "ns", "nd", "an", "loaded")


@query("sc_confidence", f"SELECT event_id, {_CONF[0]} AS confidence_score, {_CONF[1]} AS confidence_flags FROM (SELECT event_id, (event_id % 6)::DOUBLE / 5 AS dc, event_id % 4 AS ns, event_id % 3 AS nd, (event_id % 5)::DOUBLE / 4 AS an, event_id % 7 <> 0 AS loaded FROM events)")
def sc_confidence(spark, sf_dir):
    k = F.col("event_id")
    score, flags = c.confidence((k % 6).cast("double") / 5, k % 4, k % 3, (k % 5).cast("double") / 4, k % 7 != 0)
    return a.table(spark, sf_dir, "events").select("event_id", score.alias("confidence_score"), flags.alias("confidence_flags"))


@query("sc_clamp", "SELECT event_id, greatest(0.0, least(100.0, round(value * 3 - 50, 2)))::DOUBLE AS risk, greatest(0.0, least(1.0, round(value / 70 - 0.2, 4)))::DOUBLE AS unit, left(repeat(props, 40), 200) AS description FROM events")
def sc_clamp(spark, sf_dir):
    v = F.col("value")
    return a.table(spark, sf_dir, "events").select("event_id", s.clamp(v * 3 - 50, 0, 100, 2).alias("risk"), s.clamp(v / 70 - 0.2, 0, 1, 4).alias("unit"), F.substring(F.repeat("props", 40), 1, 200).alias("description"))


def newest_rows(spark, sf_dir) -> DataFrame:
    """The newest week of each port and its completeness; the gold table itself isn't needed for them."""
    sources = {
        "nws": (a.a_nws(spark, sf_dir), F.col("effective")), "gdelt": (a.a_gdelt(spark, sf_dir), s.sql_date(F.col("sql_date"))),
        "usgs": (a.a_usgs(spark, sf_dir), F.col("occurred_at")), "firms": (a.a_firms(spark, sf_dir), F.col("acquired_at")),
    }
    return weekly.newest(ports(spark), a.a_bts(spark, sf_dir), sources)


def card_frame(spark, sf_dir) -> DataFrame:
    return c.cards(impact_table(spark), newest_rows(spark, sf_dir), signals(spark, sf_dir), generated_at=AS_OF)


_CARD_CONF = _sql_confidence("dc", "ns", "0", "0.5", "FALSE")
_CARDS = f"""SELECT i.port_id, i.ord, i.name, i.region, i.impact_index, {_sql_score('0.5::DOUBLE', '0.5::DOUBLE', 'i.impact_index')} AS risk_score, dc AS data_completeness, features_week_ending, ns AS n_signals, {_CARD_CONF[0]} AS confidence_score, {_CARD_CONF[1]} AS confidence_flags
    FROM i JOIN (SELECT i.port_id, coalesce(l.dc, 0.0)::DOUBLE AS dc, l.features_week_ending, coalesce(n.ns, 0)::INTEGER AS ns FROM i LEFT JOIN (SELECT port_id, max(week_ending) AS features_week_ending, arg_max(data_completeness_score, week_ending) AS dc FROM g GROUP BY 1) l USING (port_id)
    LEFT JOIN (SELECT port_id, count(*) AS ns FROM s_all GROUP BY 1) n USING (port_id)) x USING (port_id)"""


def card_sql(body: str) -> str:
    return sql(body, *GOLD_VIEWS, **(GOLD_PARTS | _SIGNAL_PARTS | {"i": SQL_IMPACT, "cards": f"SELECT *, {_sql_tier('risk_score')} AS risk_tier, md5(port_id || ':' || coalesce(features_week_ending::VARCHAR, '') || ':7:{AS_OF} 00:00:00') AS card_id FROM ({_CARDS})"}))


@query("sc_risk_card", card_sql("SELECT port_id, name, region, risk_score, risk_tier, 0.5::DOUBLE AS p_disruption, 0.5::DOUBLE AS anomaly_score, impact_index, confidence_score, confidence_flags, data_completeness, features_week_ending, n_signals, " + _sql_actions("risk_tier") + " AS recommended_actions, 7 AS forecast_horizon_days FROM cards"))
def sc_risk_card(spark, sf_dir):
    return card_frame(spark, sf_dir).select("port_id", "name", "region", "risk_score", "risk_tier", "p_disruption", "anomaly_score", "impact_index", "confidence_score", "confidence_flags", "data_completeness", "features_week_ending", "n_signals", "recommended_actions", "forecast_horizon_days")


@query("sc_whole_card", card_sql(f"""SELECT port_id, card_id, TIMESTAMP '{AS_OF}' AS generated_at, NULL::VARCHAR AS model_version, 0 AS n_drivers, n_signals, s.listed, s.listed AS different, s.severest, s.oldest, s.chars
    FROM cards JOIN (SELECT port_id, count(s_all.signal_id) AS listed, max(severity_order) AS severest, min(observed_at) AS oldest, coalesce(sum(length(description)), 0)::BIGINT AS chars FROM cards LEFT JOIN s_all USING (port_id) GROUP BY 1) s USING (port_id)"""))
def sc_whole_card(spark, sf_dir):
    """Cards with their signals, in parts: what the parts of each port hold together."""
    found = signals(spark, sf_dir)
    parts = c.with_signals(card_frame(spark, sf_dir), found).select("port_id", "card_id", "generated_at", F.col("model_info.version").alias("model_version"), F.size("drivers").alias("n_drivers"), "n_signals", F.explode_outer("active_signals").alias("x"))
    own = parts.groupBy("port_id", "card_id", "generated_at", "model_version", "n_drivers", "n_signals")
    return own.agg(F.count("x.signal_id").alias("listed"), F.count_distinct("x.signal_id").alias("different"), (-F.min("x.o")).alias("severest"), F.min("x.observed_at").alias("oldest"), F.coalesce(F.sum(F.char_length("x.description")), F.lit(0)).alias("chars"))


@query("sc_rank_ports", card_sql("SELECT row_number() OVER (ORDER BY risk_score DESC, ord)::INTEGER AS place, port_id, risk_score, n_signals FROM cards"))
def sc_rank_ports(spark, sf_dir, by: str = "risk_score", ascending: bool = False):
    """Ports by a column, from the top or the bottom."""
    return c.ranked(card_frame(spark, sf_dir), by, ascending).select("place", "port_id", "risk_score", "n_signals")


@query("sc_rank_by_signals", card_sql("SELECT row_number() OVER (ORDER BY n_signals, ord)::INTEGER AS place, port_id, n_signals FROM cards"))
def sc_rank_by_signals(spark, sf_dir):
    """The user's choice of column and direction: fewest signals first."""
    return c.ranked(card_frame(spark, sf_dir), "n_signals", ascending=True).select("place", "port_id", "n_signals")


@query("sc_top_n", card_sql("SELECT port_id || ': ' || printf('%.2f', risk_score) || ' (' || risk_tier || '), confidence ' || printf('%.0f', confidence_score) || '%, ' || n_signals || ' signals' AS line FROM cards ORDER BY risk_score DESC, ord LIMIT 3"))
def sc_top_n(spark, sf_dir, n: int = 3):
    """The n riskiest ports, n from 1 to 10, as lines of text."""
    line = F.format_string("%s: %.2f (%s), confidence %.0f%%, %d signals", "port_id", "risk_score", "risk_tier", "confidence_score", "n_signals")
    return card_frame(spark, sf_dir).orderBy(F.desc("risk_score"), "ord").limit(max(1, min(n, 10))).select(line.alias("line"))


@query("sc_summary", card_sql("SELECT port_id, name, risk_score, risk_tier, 0.5::DOUBLE AS p_disruption, 0.5::DOUBLE AS anomaly_score, confidence_score, n_signals, NULL::VARCHAR AS top_driver, confidence_score >= 70 AS high_confidence FROM cards"))
def sc_summary(spark, sf_dir):
    return card_frame(spark, sf_dir).select("port_id", "name", "risk_score", "risk_tier", "p_disruption", "anomaly_score", "confidence_score", "n_signals", F.get("drivers", F.lit(0))["feature"].alias("top_driver"), (F.col("confidence_score") >= 70).alias("high_confidence"))


@query("sc_overview", card_sql("SELECT count_if(risk_tier = 'low')::BIGINT AS low, count_if(risk_tier = 'medium')::BIGINT AS medium, count_if(risk_tier = 'high')::BIGINT AS high, count_if(risk_tier = 'critical')::BIGINT AS critical, round(avg(risk_score), 6) AS mean_score, sum(n_signals)::BIGINT AS signals FROM cards"))
def sc_overview(spark, sf_dir):
    tiers = [F.count_if(F.col("risk_tier") == t).alias(t) for t in ("low", "medium", "high", "critical")]
    return card_frame(spark, sf_dir).agg(*tiers, F.round(F.avg("risk_score"), 6).alias("mean_score"), F.sum("n_signals").alias("signals"))


_SCENARIOS = f"SELECT doc_id AS scenario_id, {a.sql_pick(sorted(p[0] for p in a.PORTS), 'doc_id % 10')} AS port_id, {_PRED} AS p_disruption, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 11)::DOUBLE / 10 END AS anomaly_score FROM documents"


@query("sc_simulate", sql(f"""SELECT scenario_id, port_id, risk_score, {_sql_tier('risk_score')} AS risk_tier, baseline_score, round(risk_score - baseline_score, 2) AS delta_score, len({_sql_actions(f'({_sql_tier("risk_score")})')})::INTEGER AS n_actions
    FROM (SELECT scenario_id, port_id, {_sql_score('p_disruption', 'coalesce(anomaly_score, 0.5)::DOUBLE', 'impact_index')} AS risk_score, {_sql_score('0.5::DOUBLE', '0.5::DOUBLE', 'impact_index')} AS baseline_score FROM sc JOIN i USING (port_id))""", "a_ports", i=SQL_IMPACT, sc=_SCENARIOS))  # fmt: skip
def sc_simulate(spark, sf_dir):
    d, i = a.table(spark, sf_dir, "documents"), impact_table(spark)
    scenarios = d.select(F.col("doc_id").alias("scenario_id"), a.pick(sorted(p[0] for p in a.PORTS), F.col("doc_id") % 10).alias("port_id"), ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p_disruption"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 11).cast("double") / 10).alias("anomaly_score"))
    baseline = i.select("port_id", s.risk_score(F.lit(0.5), F.lit(0.5), F.col("impact_index")).alias("risk_score"))
    return c.simulate(scenarios, i, baseline).select("scenario_id", "port_id", "risk_score", "risk_tier", "baseline_score", "delta_score", F.size("recommended_actions").alias("n_actions"))


PACK_SIGNALS = c.PART_SIGNALS


def evidence_packs(cards: DataFrame, found: DataFrame, port_ids: list[str] | None = None, as_of: str | None = None, lookback_days: int = DAYS) -> DataFrame:
    """Compact JSON packs of each port: its whole card, its signals, severest first, where it lies, and the overview of all ports
    asked for. Ports with more than PACK_SIGNALS signals get numbered parts, the severest in the first; n_signals counts all.

    port_ids: the ports asked for; unknown ones are dropped, and None means every port. as_of: where given, only signals of the
    last lookback_days up to it count. max_risk is the highest score of the ports asked for, is_empty whether a port has no signals.
    """
    if port_ids is not None:
        known = [p for p in port_ids if p in SORTED_IDS]
        cards, found = cards.filter(F.col("port_id").isin(known)), found.filter(F.col("port_id").isin(known))
    if as_of is not None:
        found = c.recent(found, "observed_at", as_of, lookback_days)
    fields = [x for x in cards.columns if x not in ("ord", "n_signals")]
    place = F.struct(*[F.col(x) for x in ("port_id", "name", "region", "state", "lat", "lon")]).alias("place")
    where = ports(cards.sparkSession).select(F.col("port_id").alias("__port"), place)
    packed = c.with_signals(cards, found).join(F.broadcast(where), F.col("port_id") == F.col("__port"), "left")  # ten ports
    # Ten ports at most, so the overview is a short list.
    line = F.struct((-F.col("risk_score")).alias("o"), F.col("port_id"), F.col("risk_tier"), F.col("risk_score"))
    overview = cards.agg(F.max("risk_score").alias("max_risk"), F.transform(F.sort_array(F.collect_list(line)), lambda x: x.dropFields("o")).alias("overview"))
    packed = packed.crossJoin(F.broadcast(overview))  # one row
    pack = F.to_json(F.struct(F.struct(*fields, "n_signals").alias("risk_card"), F.col("active_signals"), F.col("place").alias("port"), F.col("overview")))
    return packed.select("port_id", "n_signals", "risk_score", pack.alias("pack"), "part", "parts", "max_risk", (F.col("n_signals") == 0).alias("is_empty"))


_PACK_JSON = "risk_card struct<port_id:string,risk_tier:string,card_id:string>, port struct<state:string,lat:double,lon:double>, active_signals array<struct<signal_id:string,severity:string>>, overview array<struct<port_id:string>>"
_PACKS = f"""SELECT port_id, risk_score, risk_tier, max(risk_score) OVER () AS max_risk, n_signals, n_signals = 0 AS is_empty, n_signals::BIGINT AS listed, n_signals::BIGINT AS different,
    CASE WHEN n_signals <= {PACK_SIGNALS} THEN 1 ELSE (SELECT sum(-((-n) // {PACK_SIGNALS})) FROM (SELECT severity_order, count(*) AS n FROM s_all WHERE s_all.port_id = cards.port_id GROUP BY 1)) END::INTEGER AS parts, 10 AS ports_in_overview, card_id, state, lat, lon FROM cards JOIN (SELECT port_id, state, lat, lon FROM a_ports) USING (port_id)"""


@query("sc_evidence_pack", card_sql(_PACKS))
def sc_evidence_pack(spark, sf_dir):
    """Packs of all ports, read back from their JSON: each port's signals are in its parts, each once."""
    packs = evidence_packs(card_frame(spark, sf_dir), signals(spark, sf_dir)).withColumn("p", F.from_json("pack", _PACK_JSON))
    each = packs.select("port_id", "risk_score", "p.risk_card.risk_tier", "max_risk", "n_signals", "is_empty", "parts", F.size("p.overview").alias("ports_in_overview"), "p.risk_card.card_id", "p.port.state", "p.port.lat", "p.port.lon", F.size("p.active_signals").alias("n"))
    own = packs.select("port_id", F.explode("p.active_signals").alias("x")).groupBy("port_id").agg(F.count_distinct("x.signal_id").alias("different"))
    each = each.groupBy("port_id", "risk_score", "risk_tier", "max_risk", "n_signals", "is_empty", "parts", "ports_in_overview", "card_id", "state", "lat", "lon").agg(F.sum("n").alias("listed"))
    return each.join(own, "port_id", "left").withColumn("different", F.coalesce("different", F.lit(0)))
