"""Projections, filters, joins, weekly aggregates, window features and the gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.adapters import sql, sql_week
from quaystone.functions import scalar as s
from quaystone.operators import cells, geo, places, quantiles, series, weekly, windows
from quaystone.plans.registry import query, rounded
from quaystone.registry import ALERT_WORDS, DEFAULT_BASE_HOURS, DEFAULT_IMPACT, EVENT_CODES, GOLD_COLUMNS, HAZARD_KM, LAG_WORDS, MIN_MAGNITUDE, MODEL_COLUMNS, PORTS, ROOT_CODES, WHOLE_COLUMNS, ZERO_FILLED, ports
from quaystone.sources import lake

# Projections ---------------------------------------------------------------------------------------------------------


@query("dim_ports", sql("SELECT ord, enc, port_id, name, lat, lon, state, region, nws_zone, teu_m, base_hrs, count(e.event_id) AS events FROM a_ports p LEFT JOIN events e ON e.user_id % 10 = p.enc GROUP BY ALL", "a_ports"))
def dim_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, with the number of events of each port's users."""
    events = a.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).cast("int").alias("enc")).agg(F.count("event_id").alias("events"))
    return ports(spark).join(events, "enc", "left").withColumn("events", F.coalesce("events", F.lit(0)))


@query("prj_week_ending", f"SELECT event_id, {sql_week('ts')} AS week_ending FROM events")
def prj_week_ending(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", s.week_ending(F.col("ts")).alias("week_ending"))


@query("prj_lenient_cast", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS bad, coalesce(TRY_CAST(left(event_type, 1) || json_extract_string(props, '$.k') AS DOUBLE), -1) AS worse FROM events")
def prj_lenient_cast(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return a.table(spark, sf_dir, "events").select("event_id", s.lenient(k).alias("k"), s.lenient(F.col("event_type")).alias("bad"), s.lenient(F.concat(F.substring("event_type", 1, 1), k), default=-1).alias("worse"))


@query("prj_completeness", "SELECT o_orderkey, round(((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END))::DOUBLE / 3, 3) AS completeness FROM orders")
def prj_completeness(spark, sf_dir):
    """The helper sees nulls: three columns that are null for some keys."""
    marks = [F.when(F.col("o_orderkey") % n == 0, 1) for n in (2, 3, 5)]
    return a.table(spark, sf_dir, "orders").select("o_orderkey", s.completeness(marks).alias("completeness"))


@query("prj_haversine", sql(f"SELECT r.usgs_id, p.port_id, round({a._km('r.lat', 'r.lon')}, 6) AS km FROM a_usgs_raw r, a_ports p", "a_ports", "a_usgs_raw"))
def prj_haversine(spark, sf_dir):
    p = ports(spark).select("port_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    near = a.a_usgs_raw(spark, sf_dir).crossJoin(F.broadcast(p))  # ten ports
    return near.select("usgs_id", "port_id", F.round(s.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("prj_calendar", "SELECT o_orderkey, weekofyear(o_orderdate)::INTEGER AS week_of_year, month(o_orderdate)::INTEGER AS month, (month(o_orderdate) >= 10)::INTEGER AS is_q4 FROM orders")
def prj_calendar(spark, sf_dir):
    d = F.col("o_orderdate")
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month"), (F.month(d) >= 10).cast("int").alias("is_q4"))


_SEVERITY_TEXT = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '  ' ELSE '  ' || upper(severity) || ' ' END"


@query("prj_normalise", sql(f"""SELECT alert_id, CASE WHEN coalesce(trim(raw), '') = '' THEN 'Unknown' ELSE upper(left(trim(raw), 1)) || lower(substr(trim(raw), 2)) END AS severity,
    CASE lower(mark) WHEN 'l' THEN 'low' WHEN 'n' THEN 'nominal' WHEN 'h' THEN 'high' ELSE lower(mark) END AS confidence
    FROM (SELECT alert_id, {_SEVERITY_TEXT} AS raw, (['L', 'n', 'H', 'Nominal'])[(event_id % 4)::INTEGER + 1] AS mark FROM a_nws)""", "a_nws"))  # fmt: skip
def prj_normalise(spark, sf_dir):
    n = a.a_nws(spark, sf_dir)
    raw = F.when(F.col("event_id") % 13 == 0, None).when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("  "), F.upper("severity"), F.lit(" ")))
    mark = F.lower(a.pick(["L", "n", "H", "Nominal"], F.col("event_id") % 4))
    return n.select("alert_id", F.coalesce(F.nullif(F.initcap(F.trim(raw)), F.lit("")), F.lit("Unknown")).alias("severity"), F.coalesce(s.lookup(mark, {"l": "low", "n": "nominal", "h": "high"}), mark).alias("confidence"))


@query("prj_clip_outliers", "WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders) SELECT o_orderkey, round(greatest(lo, least(hi, o_totalprice)), 6) AS price FROM orders, b")
def prj_clip_outliers(spark, sf_dir):
    """To the 1st and 99th percentile."""
    o = a.table(spark, sf_dir, "orders")
    low, high = quantiles.percentiles(o, "o_totalprice", [0.01, 0.99])
    return o.select("o_orderkey", F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("o_totalprice"))), 6).alias("price"))


# Filters and joins ---------------------------------------------------------------------------------------------------


@query("flt_root_code", sql(f"SELECT global_event_id, event_root_code FROM a_gdelt_raw WHERE left(event_code, 2) IN {ROOT_CODES}", "a_gdelt_raw"))
def flt_root_code(spark, sf_dir):
    code = F.col("event_code")
    return a.a_gdelt_raw(spark, sf_dir).filter(code.startswith("14") | code.startswith("17") | code.startswith("20")).select("global_event_id", "event_root_code")


@query("flt_quake_query", sql(f"""SELECT usgs_id, port_id, round(distance_km, 4) AS distance_km FROM (SELECT r.usgs_id, p.port_id, {a._km('r.lat', 'r.lon')} AS distance_km,
    row_number() OVER (PARTITION BY p.port_id ORDER BY r.occurred_at DESC, r.event_id) AS rk FROM a_usgs_raw r, a_ports p
    WHERE r.magnitude >= {MIN_MAGNITUDE} AND r.occurred_at BETWEEN TIMESTAMP '2001-01-05' AND TIMESTAMP '2001-01-25' AND {a._km('r.lat', 'r.lon')} <= {HAZARD_KM}) WHERE rk <= 100""", "a_ports", "a_usgs_raw"))  # fmt: skip
def flt_quake_query(spark, sf_dir):
    """Magnitude, time and radius, then the 100 newest of each port (the cap is the feature)."""
    q = a.a_usgs_raw(spark, sf_dir).filter((F.col("magnitude") >= MIN_MAGNITUDE) & F.col("occurred_at").between(F.lit("2001-01-05").cast("timestamp_ntz"), F.lit("2001-01-25").cast("timestamp_ntz")))
    near = geo.within_radius(q, ports(spark), HAZARD_KM)
    return windows.top_per_key(near, ["port_id"], 100, F.desc("occurred_at"), F.col("event_id")).select("usgs_id", "port_id", F.round("distance_km", 4).alias("distance_km"))


_BOX = geo.registry_box()


@query("flt_bbox", sql(f"SELECT event_id, lat, lon FROM a_firms_raw WHERE lon BETWEEN {_BOX[0]}::DOUBLE AND {_BOX[2]}::DOUBLE AND lat BETWEEN {_BOX[1]}::DOUBLE AND {_BOX[3]}::DOUBLE", "a_firms_raw"))
def flt_bbox(spark, sf_dir):
    return geo.in_box(a.a_firms_raw(spark, sf_dir)).select("event_id", "lat", "lon")


@query("join_nearest_port", sql("SELECT global_event_id, port_id, round(distance_km, 4) AS distance_km FROM a_gdelt", "a_gdelt"))
def join_nearest_port(spark, sf_dir):
    return a.a_gdelt(spark, sf_dir).select("global_event_id", "port_id", F.round("distance_km", 4).alias("distance_km"))


@query("join_radius", sql(f"""SELECT usgs_id, port_id, round(distance_km, 4) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY usgs_id ORDER BY ord) AS rk
    FROM (SELECT r.usgs_id, p.port_id, p.ord, {a._km('r.lat', 'r.lon')} AS distance_km FROM a_usgs_raw r, a_ports p) WHERE distance_km <= {HAZARD_KM * 5}) WHERE rk = 1""", "a_ports", "a_usgs_raw"))  # fmt: skip
def join_radius(spark, sf_dir):
    """Radius wide enough that ports overlap; the first port of the registry wins."""
    near = geo.within_radius(a.a_usgs_raw(spark, sf_dir), ports(spark), HAZARD_KM * 5)
    return geo.first_port_wins(near, "usgs_id").select("usgs_id", "port_id", F.round("distance_km", 4).alias("distance_km"))


_SITES = f"SELECT 's' || s_suppkey AS port_id, s_suppkey AS ord, {a._sql_where('s_suppkey')[0]} AS lat, {a._sql_where('s_suppkey')[1]} AS lon FROM supplier"
SITE_KM = 120.0


def _sites(spark, sf_dir) -> DataFrame:
    """A registry that grows with the tables: suppliers as sites."""
    return a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("port_id"), F.col("s_suppkey").alias("ord"), a._lat("s_suppkey").alias("lat"), a._lon("s_suppkey").alias("lon"))


@query("join_nearest_site", sql(f"""SELECT global_event_id, port_id, round(distance_km, 4) AS distance_km FROM (SELECT r.global_event_id, p.port_id, {a._km('r.lat', 'r.lon')} AS distance_km,
    row_number() OVER (PARTITION BY r.global_event_id ORDER BY round({a._km('r.lat', 'r.lon')}, 6), p.ord) AS rk FROM a_gdelt_raw r, p WHERE r.lat IS NOT NULL) WHERE rk = 1 AND distance_km <= {SITE_KM}""", "a_gdelt_raw", p=_SITES))  # fmt: skip
def join_nearest_site(spark, sf_dir):
    """The nearest of any number of sites, by cells of the sphere; the first site wins where the distances are equal."""
    near = cells.nearest(a.a_gdelt_raw(spark, sf_dir), _sites(spark, sf_dir), SITE_KM)
    return near.select("global_event_id", "port_id", F.round("distance_km", 4).alias("distance_km"))


@query("join_sites_in_radius", sql(f"SELECT r.usgs_id, p.port_id, round({a._km('r.lat', 'r.lon')}, 4) AS distance_km FROM a_usgs_raw r, p WHERE {a._km('r.lat', 'r.lon')} <= {SITE_KM}", "a_usgs_raw", p=_SITES))
def join_sites_in_radius(spark, sf_dir):
    """Every site within a radius of each earthquake: an equi-join on cells."""
    return cells.within(a.a_usgs_raw(spark, sf_dir), _sites(spark, sf_dir), SITE_KM).select("usgs_id", "port_id", F.round("distance_km", 4).alias("distance_km"))


_STATES = ["CA", "NJ", "GA", "WA", "TX"]
_AREAS = ["Coastal waters off Oakland", "Greater Los Angeles basin", "Savannah river", "Puget Sound"]


@query("join_state_text", sql(f"""SELECT alert_id, port_id FROM (SELECT n.alert_id, p.port_id, row_number() OVER (PARTITION BY n.alert_id ORDER BY contains(lower(n.area), lower(split_part(p.name, '/', 1)[:greatest(length(trim(split_part(p.name, '/', 1))), 1)])) DESC, p.ord) AS rk
    FROM (SELECT alert_id, {a.sql_pick(_STATES, 'event_id % 5')} AS state, {a.sql_pick(_AREAS, 'event_id % 4')} AS area FROM a_nws) n JOIN a_ports p USING (state)) WHERE rk = 1""", "a_nws", "a_ports"))  # fmt: skip
def join_state_text(spark, sf_dir):
    """Alert to port by state; where a state has several, one whose city is in the area's text, else the first."""
    n = a.a_nws(spark, sf_dir).select("alert_id", a.pick(_STATES, F.col("event_id") % 5).alias("state"), F.lower(a.pick(_AREAS, F.col("event_id") % 4)).alias("area"))
    city = F.lower(F.trim(F.get(F.split("name", "/"), F.lit(0))))
    p = F.broadcast(ports(spark).select("port_id", "ord", "state", city.alias("city")))
    return windows.keep_first(n.join(p, "state"), ["alert_id"], F.desc(F.col("area").contains(F.col("city"))), F.col("ord")).select("alert_id", "port_id")


@query("join_place_names", """WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS state, 'Storm off S' || (o_custkey % 120) || '-S' || (o_orderkey % 97) || '.' AS area FROM orders),
    p AS (SELECT 's' || s_suppkey AS port_id, s_suppkey AS ord, s_suppkey % 7 AS state, 'S' || s_suppkey AS name FROM supplier)
    SELECT o_orderkey, port_id FROM (SELECT o_orderkey, port_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY contains(lower(area), lower(name)) DESC, ord) AS rk FROM t JOIN p USING (state)) WHERE rk = 1""")
def join_place_names(spark, sf_dir):
    """Texts to places of their state by the names they hold, any number of names in one scan of a text."""
    key = F.col("o_orderkey")
    area = F.concat(F.lit("Storm off S"), (F.col("o_custkey") % 120).cast("string"), F.lit("-S"), (key % 97).cast("string"), F.lit("."))
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", (key % 7).alias("state"), area.alias("area"))
    sites = _sites(spark, sf_dir).select("port_id", "ord", (F.col("ord") % 7).alias("state"), F.upper("port_id").alias("name"))
    return places.place_of_text(rows, "o_orderkey", "area", sites)


# Weekly aggregates ---------------------------------------------------------------------------------------------------


def _flag(words: tuple[str, ...]) -> str:
    return "max((" + " OR ".join(f"contains(lower(event_type), '{w}')" for w in words) + ")::INTEGER)"


_SCORE = "CASE severity WHEN 'Extreme' THEN 4 WHEN 'Severe' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END"
W_WEATHER = f"""SELECT port_id, {sql_week('effective')} AS week_ending, count(alert_id) AS alert_count, count_if({_SCORE} = 4)::BIGINT AS extreme_alert_count, count_if({_SCORE} = 3)::BIGINT AS severe_alert_count,
    {', '.join(f'{_flag(w)} AS has_{n}_alert' for n, w in ALERT_WORDS.items())}, max({_SCORE}) AS max_severity_score FROM a_nws GROUP BY 1, 2"""
W_NEWS = f"""SELECT port_id, {sql_week("strptime(sql_date, '%Y%m%d')")} AS week_ending, count(global_event_id) AS gdelt_event_count, count_if(event_root_code = '14')::BIGINT AS gdelt_strike_count,
    count_if(event_root_code = '17')::BIGINT AS gdelt_coerce_count, count_if(event_root_code = '20')::BIGINT AS gdelt_conflict_count, avg(goldstein_scale) AS gdelt_goldstein_avg, min(goldstein_scale) AS gdelt_goldstein_min,
    avg(avg_tone) AS gdelt_avg_tone, sum(num_articles)::DOUBLE AS gdelt_num_articles_total, sum(num_mentions)::DOUBLE AS gdelt_num_mentions_total,
    sum(CASE WHEN goldstein_scale < 0 THEN -goldstein_scale * num_mentions ELSE 0.0::DOUBLE END) AS gdelt_weighted_disruption FROM a_gdelt GROUP BY 1, 2"""
W_QUAKE = f"""SELECT port_id, {sql_week('occurred_at')} AS week_ending, count(usgs_id) AS eq_count, max(magnitude) AS eq_max_magnitude, sum(pow(10.0::DOUBLE, 1.5 * magnitude)) AS eq_energy_proxy,
    max(tsunami_flag::INTEGER) AS eq_tsunami_flag, min(depth_km) AS eq_depth_min_km FROM a_usgs GROUP BY 1, 2"""
W_FIRE = f"""SELECT port_id, {sql_week('acquired_at')} AS week_ending, count(*) AS fire_count, count_if(confidence = 'high')::BIGINT AS fire_high_confidence_count, max(frp) AS fire_max_frp, sum(frp) AS fire_total_frp FROM a_firms GROUP BY 1, 2"""


def _round(view: str, names: list[str], digits: dict[str, int] | None = None) -> str:
    """SELECT * of view with some columns rounded."""
    return f"SELECT * REPLACE ({', '.join(f'round({n}, {(digits or {}).get(n, 6)}) AS {n}' for n in names)}) FROM {view}"


_NEWS_DOUBLES = ["gdelt_goldstein_avg", "gdelt_goldstein_min", "gdelt_avg_tone", "gdelt_num_articles_total", "gdelt_num_mentions_total", "gdelt_weighted_disruption"]


@query("agg_weather", sql("SELECT * FROM w", "a_nws", w=W_WEATHER))
def agg_weather(spark, sf_dir):
    return weekly.weather_weekly(a.a_nws(spark, sf_dir))


@query("agg_news", sql(_round("w", _NEWS_DOUBLES), "a_gdelt", w=W_NEWS))
def agg_news(spark, sf_dir):
    return rounded(weekly.news_weekly(a.a_gdelt(spark, sf_dir)))


@query("agg_quake", sql(_round("w", ["eq_max_magnitude", "eq_energy_proxy", "eq_depth_min_km"], {"eq_energy_proxy": 0}), "a_usgs", w=W_QUAKE))
def agg_quake(spark, sf_dir):
    return rounded(weekly.quake_weekly(a.a_usgs(spark, sf_dir)), eq_energy_proxy=0)


@query("agg_fire", sql(_round("w", ["fire_max_frp", "fire_total_frp"]), "a_firms", w=W_FIRE))
def agg_fire(spark, sf_dir):
    return rounded(weekly.fire_weekly(a.a_firms(spark, sf_dir)))


# Spine, windows, gold ------------------------------------------------------------------------------------------------

_SPINE = "SELECT p.port_id, w::DATE AS week_ending FROM (SELECT unnest(generate_series(min(week_ending)::TIMESTAMP, max(week_ending)::TIMESTAMP, INTERVAL 7 DAY)) AS w FROM a_bts) s, a_ports p"


@query("spine_port_week", sql(_SPINE, "a_bts", "a_ports"))
def spine_port_week(spark, sf_dir):
    return weekly.spine(ports(spark), a.a_bts(spark, sf_dir))


@query("spine_fallback", sql(f"SELECT p.port_id, d.w::DATE AS week_ending, (SELECT count(*) FROM events) AS events FROM a_ports p, (SELECT unnest(generate_series(DATE '2001-02-04' - INTERVAL 721 DAY, TIMESTAMP '2001-02-04', INTERVAL 7 DAY)) AS w) d", "a_ports"))
def spine_fallback(spark, sf_dir):
    """Without throughput rows: the last 104 weeks; with the number of events, which shows that the other feeds are there."""
    n = a.table(spark, sf_dir, "events").agg(F.count("*").alias("events"))
    return weekly.fallback_spine(ports(spark), a.AS_OF).crossJoin(F.broadcast(n))


_X = "median_berthing_time_hrs"
_DEDUP = "SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY port_id, week_ending ORDER BY ingested_at DESC, vessel_call_count DESC, median_berthing_time_hrs DESC) AS rk FROM {src}) WHERE rk = 1"


def _over(rows: int, last: int = 0) -> str:
    return f"OVER (PARTITION BY port_id ORDER BY week_ending ROWS BETWEEN {rows - 1 - last} PRECEDING AND {f'{-last} PRECEDING' if last else 'CURRENT ROW'})"


def _guard(value: str, rows: int, least: int, last: int = 0) -> str:
    return f"CASE WHEN count({_X}) {_over(rows, last)} >= {least} THEN {value} {_over(rows, last)} END"


_BYW = "OVER (PARTITION BY port_id ORDER BY week_ending)"
_P75 = _guard(f"quantile_cont({_X}, 0.75)", 52, 4, -1)


def _pct(c: str) -> str:
    return f"coalesce(({c} - lag({c}) {_BYW})::DOUBLE / nullif(lag({c}) {_BYW}, 0) * 100, 0.0)::DOUBLE"


F_PORT = f"""SELECT *, CASE WHEN berthing_time_p75_52w IS NOT NULL THEN coalesce(({_X} > berthing_time_p75_52w)::INTEGER, 0) END AS is_disruption_week FROM (
    SELECT port_id, week_ending, {_X}, avg_berthing_time_hrs, vessel_call_count, lag({_X}, 1) {_BYW} AS berthing_time_lag_1w, lag({_X}, 2) {_BYW} AS berthing_time_lag_2w, lag({_X}, 4) {_BYW} AS berthing_time_lag_4w,
    {_pct(_X)} AS berthing_time_pct_change_1w, {_pct('vessel_call_count')} AS call_count_pct_change_1w,
    {_guard(f'avg({_X})', 4, 2)} AS berthing_time_4w_avg, {_guard(f'stddev_samp({_X})', 4, 2)} AS berthing_time_4w_std,
    {_guard(f'avg({_X})', 52, 4)} AS berthing_time_52w_avg, {_guard(f'stddev_samp({_X})', 52, 4)} AS berthing_time_52w_std,
    ({_X} - {_guard(f'avg({_X})', 52, 4)}) / greatest({_guard(f'stddev_samp({_X})', 52, 4)}, 1e-6) AS berthing_time_z_score_52w, {_P75} AS berthing_time_p75_52w,
    weekofyear(week_ending)::INTEGER AS week_of_year, month(week_ending)::INTEGER AS month, (month(week_ending) >= 10)::INTEGER AS is_q4 FROM f_latest)"""


def port_sql(columns: str, source: str = "a_bts_dup") -> str:
    return sql(f"SELECT port_id, week_ending, {columns} FROM f_port", source, f_latest=_DEDUP.format(src=source), f_port=F_PORT)


def _features(spark, sf_dir) -> DataFrame:
    return windows.port_features(a.a_bts_dup(spark, sf_dir))


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("win_lags", port_sql(_r("berthing_time_lag_1w", "berthing_time_lag_2w", "berthing_time_lag_4w")))
def win_lags(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_lag_1w", "berthing_time_lag_2w", "berthing_time_lag_4w"))


@query("win_pct_change", port_sql(_r("berthing_time_pct_change_1w", "call_count_pct_change_1w")))
def win_pct_change(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_pct_change_1w", "call_count_pct_change_1w"))


@query("win_rolling_4w", port_sql(_r("berthing_time_4w_avg", "berthing_time_4w_std")))
def win_rolling_4w(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_4w_avg", "berthing_time_4w_std"))


@query("win_rolling_52w", port_sql(_r("berthing_time_52w_avg", "berthing_time_52w_std")))
def win_rolling_52w(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_52w_avg", "berthing_time_52w_std"))


@query("win_zscore", port_sql(_r("berthing_time_z_score_52w")))
def win_zscore(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_z_score_52w"))


@query("win_p75_prior", port_sql(_r("berthing_time_p75_52w")))
def win_p75_prior(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("port_id", "week_ending", "berthing_time_p75_52w"))


@query("win_disruption_label", port_sql(f"{_X}, is_disruption_week"))
def win_disruption_label(spark, sf_dir):
    return _features(spark, sf_dir).select("port_id", "week_ending", _X, "is_disruption_week")


_LONG = "OVER (PARTITION BY port_id ORDER BY l_shipdate, l_orderkey, l_linenumber, x ROWS BETWEEN {} PRECEDING AND {})"
_LONG_NOW, _LONG_PRIOR = _LONG.format(999, "CURRENT ROW"), _LONG.format(1000, "1 PRECEDING")


@query("win_long_series", f"""SELECT port_id, l_shipdate, l_orderkey, l_linenumber, n AS roll_n, round(CASE WHEN n >= 4 THEN m END, 9) AS roll_mean, round(CASE WHEN n >= 4 THEN s END, 6) AS roll_std, round(CASE WHEN n >= 4 THEN (x - m) / greatest(s, 1e-6) END, 6) AS roll_z, round(CASE WHEN before >= 4 THEN p END, 6) AS roll_prior
    FROM (SELECT *, count(x) {_LONG_NOW} AS n, avg(x) {_LONG_NOW} AS m, stddev_samp(x) {_LONG_NOW} AS s, count(x) {_LONG_PRIOR} AS before, quantile_cont(x, 0.75) {_LONG_PRIOR} AS p
    FROM (SELECT {a.sql_pick(a.SORTED_IDS, 'l_suppkey % 10')} AS port_id, l_shipdate, l_orderkey, l_linenumber, l_quantity::DOUBLE AS x FROM lineitem))""")
def win_long_series(spark, sf_dir):
    """Frames of 1000 rows over each port's single shipments, its series cut into ranges. Means of up to 1000 whole numbers have
    nine digits at most where they end, so nine never round a tie."""
    x = a.table(spark, sf_dir, "lineitem").select(a.pick(a.SORTED_IDS, F.col("l_suppkey") % 10).alias("port_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"))
    return rounded(series.rolling(x, "port_id", "l_shipdate", "x", 1000, ties=["l_orderkey", "l_linenumber", "x"]).drop("x"), roll_mean=9)


@query("win_dedup_latest", sql(f"SELECT port_id, week_ending, {_X}, ingested_at FROM f_latest", "a_bts_dup", f_latest=_DEDUP.format(src="a_bts_dup")))
def win_dedup_latest(spark, sf_dir):
    return windows.latest_bts(a.a_bts_dup(spark, sf_dir)).select("port_id", "week_ending", _X, "ingested_at")


@query("win_dedup_first", sql("SELECT event_type, port_id, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, port_id ORDER BY effective, event_id) AS rk FROM a_nws) WHERE rk = 1", "a_nws"))
def win_dedup_first(spark, sf_dir):
    return windows.keep_first(a.a_nws(spark, sf_dir), ["event_type", "port_id"], F.col("effective"), F.col("event_id")).select("event_type", "port_id", "alert_id")


@query("win_ffill", sql(f"SELECT port_id, week_ending, last_value(gappy IGNORE NULLS) OVER (PARTITION BY port_id ORDER BY week_ending ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT *, CASE WHEN teu_count % 300 = 0 THEN NULL ELSE {_X} END AS gappy FROM a_bts)", "a_bts"))
def win_ffill(spark, sf_dir):
    gappy = F.when(F.col("teu_count") % 300 == 0, None).otherwise(F.col(_X))
    return a.a_bts(spark, sf_dir).withColumn("gappy", gappy).select("port_id", "week_ending", windows.forward_fill(F.col("gappy")).alias("filled"))


@query("win_latest_per_port", sql(f"SELECT port_id, max(week_ending) AS week_ending, arg_max({_X}, week_ending) AS {_X} FROM a_bts GROUP BY port_id", "a_bts"))
def win_latest_per_port(spark, sf_dir):
    return a.a_bts(spark, sf_dir).groupBy("port_id").agg(F.max("week_ending").alias("week_ending"), F.max_by(_X, "week_ending").alias(_X))


@query("win_topn_per_port", sql("SELECT port_id, global_event_id FROM (SELECT *, row_number() OVER (PARTITION BY port_id ORDER BY sql_date DESC, global_event_id) AS rk FROM a_gdelt) WHERE rk <= 20", "a_gdelt"))
def win_topn_per_port(spark, sf_dir):
    return windows.top_per_key(a.a_gdelt(spark, sf_dir), ["port_id"], 20, F.desc("sql_date"), F.col("global_event_id")).select("port_id", "global_event_id")


def gold_frame(spark: SparkSession, sf_dir: str, throughput: DataFrame | None = None) -> DataFrame:
    throughput = a.a_bts(spark, sf_dir) if throughput is None else throughput
    news, quakes, fires = weekly.news_weekly(a.a_gdelt(spark, sf_dir)), weekly.quake_weekly(a.a_usgs(spark, sf_dir)), weekly.fire_weekly(a.a_firms(spark, sf_dir))
    return weekly.gold(ports(spark), windows.port_features(throughput), weekly.weather_weekly(a.a_nws(spark, sf_dir)), news, quakes, fires, a.AS_OF)


GOLD_VIEWS = ("a_bts", "a_ports", "a_nws", "a_gdelt", "a_usgs", "a_firms")
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" if c in ZERO_FILLED else c for c in GOLD_COLUMNS if c not in ("data_completeness_score",))
GOLD_PARTS = {
    "f_latest": _DEDUP.format(src="a_bts"), "f_port": F_PORT, "w1": W_WEATHER, "w2": W_NEWS, "w3": W_QUAKE, "w4": W_FIRE, "spine": _SPINE,
    "g": f"""SELECT {_FILLED}, round((({_X} IS NOT NULL)::INTEGER + ((SELECT count(*) FROM w1) > 0)::INTEGER + ((SELECT count(*) FROM w2) > 0)::INTEGER + ((SELECT count(*) FROM w3) > 0)::INTEGER + ((SELECT count(*) FROM w4) > 0)::INTEGER)::DOUBLE / 5, 3) AS data_completeness_score
        FROM spine LEFT JOIN f_port USING (port_id, week_ending) LEFT JOIN w1 USING (port_id, week_ending) LEFT JOIN w2 USING (port_id, week_ending) LEFT JOIN w3 USING (port_id, week_ending) LEFT JOIN w4 USING (port_id, week_ending)""",
}


def gold_sql(body: str, *views: str, **more: str) -> str:
    return sql(body, *GOLD_VIEWS, *views, **(GOLD_PARTS | more))


_GOLD_DOUBLES = [c for c in GOLD_COLUMNS if c.startswith(("median", "avg_", "berthing", "call_count")) or c in (*_NEWS_DOUBLES, "eq_max_magnitude", "eq_energy_proxy", "eq_depth_min_km", "fire_max_frp", "fire_total_frp")]


GOLD_ROUNDED = f"SELECT {', '.join(f'round({c}, {0 if "energy" in c else 6}) AS {c}' if c in _GOLD_DOUBLES else c for c in GOLD_COLUMNS)} FROM g"


@query("gold_features", gold_sql(GOLD_ROUNDED))
def gold_features(spark, sf_dir):
    """The gold table as it reads back from the lake, in the order of port and week."""
    root = lake.scratch(spark)
    lake.write_gold(gold_frame(spark, sf_dir), root)
    return rounded(lake.read_gold(spark, root), eq_energy_proxy=0).orderBy("port_id", "week_ending")


_LAST_WEEKS = "SELECT p.port_id, d.w::DATE AS week_ending FROM a_ports p, (SELECT unnest(generate_series(DATE '2001-02-04' - INTERVAL 721 DAY, TIMESTAMP '2001-02-04', INTERVAL 7 DAY)) AS w) d"


@query("gold_without_throughput", gold_sql(GOLD_ROUNDED, f_latest=_DEDUP.format(src="(SELECT * FROM a_bts WHERE FALSE)"), spine=_LAST_WEEKS))
def gold_without_throughput(spark, sf_dir):
    """Before the first throughput row: the last 104 weeks with what the event feeds have."""
    return rounded(gold_frame(spark, sf_dir, a.a_bts(spark, sf_dir).filter("FALSE")), eq_energy_proxy=0)


@query("agg_gold_summary", gold_sql("SELECT count(*) AS gold_rows, count(DISTINCT port_id) AS ports, sum(is_disruption_week)::BIGINT AS disruption_weeks, round(avg(data_completeness_score), 6) AS mean_completeness FROM g"))
def agg_gold_summary(spark, sf_dir):
    return gold_frame(spark, sf_dir).agg(F.count("*").alias("gold_rows"), F.count_distinct("port_id").alias("ports"), F.sum("is_disruption_week").alias("disruption_weeks"), F.round(F.avg("data_completeness_score"), 6).alias("mean_completeness"))


@query("agg_label_dist", gold_sql("SELECT is_disruption_week, count(*) AS n FROM g WHERE is_disruption_week IS NOT NULL GROUP BY 1"))
def agg_label_dist(spark, sf_dir):
    return gold_frame(spark, sf_dir).filter("is_disruption_week IS NOT NULL").groupBy("is_disruption_week").agg(F.count("*").alias("n"))


def _kind(c: str) -> str:
    return {"port_id": "text", "week_ending": "date"}.get(c, "whole" if c in WHOLE_COLUMNS else "real")


def _profile_sql(c: str) -> str:
    number = f"round(min({c})::DOUBLE, {0 if 'energy' in c else 6})" if _kind(c) in ("whole", "real") else "NULL::DOUBLE"
    text = f"min({c})::VARCHAR" if _kind(c) in ("text", "date") else "NULL::VARCHAR"
    return f"SELECT '{c}' AS column_name, '{_kind(c)}' AS kind, count({c}) AS non_null, count(*) AS gold_rows, {number} AS sample_number, {text} AS sample_text FROM g"


def column_profile(df: DataFrame) -> DataFrame:
    """Kind, non-null count and a sample (the smallest value) of each column, in one pass, as rows."""
    kinds = {c: "date" if t == "date" else "text" if t == "string" else "real" if t in ("double", "float") else "whole" for c, t in df.dtypes}
    one = df.agg(F.count("*").alias("__n"), *[F.struct(F.count(c).alias("n"), F.min(c).alias("v")).alias(c) for c in df.columns])
    number = lambda c: F.col(f"{c}.v").cast("double") if kinds[c] in ("whole", "real") else F.lit(None).cast("double")
    text = lambda c: F.col(f"{c}.v").cast("string") if kinds[c] in ("text", "date") else F.lit(None).cast("string")
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(f"{c}.n").alias("non_null"), F.col("__n").alias("gold_rows"), number(c).alias("sample_number"), text(c).alias("sample_text")) for c in df.columns]
    return one.select(F.inline(F.array(*rows)))


@query("agg_column_profile", gold_sql(" UNION ALL ".join(_profile_sql(c) for c in GOLD_COLUMNS)))
def agg_column_profile(spark, sf_dir):
    digits = F.when(F.col("column_name").contains("energy"), F.round("sample_number", 0)).otherwise(F.round("sample_number", 6))
    return column_profile(gold_frame(spark, sf_dir)).withColumn("sample_number", digits)


# Throughput proxy, impact, feature matrix ------------------------------------------------------------------------------


_HOURS = f"coalesce(p.base_hrs, {DEFAULT_BASE_HOURS}) * (b.teu_count::DOUBLE / m.median_teu)"


@query("agg_teu_proxy", sql(f"""SELECT b.port_id, array_to_string(list_transform(string_split(b.port_id, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS port_name, b.week_ending, m.median_teu, floor({_HOURS} * 100 + 0.5::DOUBLE) / 100 AS berthing_hrs
    FROM a_bts b JOIN (SELECT port_id, list_sort(list(teu_count))[len(list(teu_count)) // 2 + 1] AS median_teu FROM a_bts GROUP BY port_id) m USING (port_id) LEFT JOIN a_ports p USING (port_id)""", "a_bts", "a_ports"))  # fmt: skip
def agg_teu_proxy(spark, sf_dir):
    """Hours from throughput to two digits, against the upper median of the port: the middle of the values from above."""
    b = a.a_bts(spark, sf_dir).select("port_id", "week_ending", "teu_count")
    medians = b.groupBy("port_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY teu_count DESC)").cast("long").alias("median_teu"))
    hours = F.coalesce("base_hrs", F.lit(DEFAULT_BASE_HOURS)) * (F.col("teu_count") / F.col("median_teu"))
    name = F.initcap(F.replace("port_id", F.lit("_"), F.lit(" ")))
    return b.join(F.broadcast(medians), "port_id").join(F.broadcast(ports(spark).select("port_id", "base_hrs")), "port_id", "left").select("port_id", name.alias("port_name"), "week_ending", "median_teu", (F.floor(hours * 100 + 0.5) / 100).alias("berthing_hrs"))


def impact_table(spark: SparkSession) -> DataFrame:
    p = ports(spark)
    top = max(r[7] for r in PORTS)
    return p.select("port_id", "ord", "name", "region", F.round(F.col("teu_m") / top, 4).alias("impact_index"))


SQL_IMPACT = "SELECT port_id, ord, name, region, round(teu_m / max(teu_m) OVER (), 4) AS impact_index FROM a_ports"


@query("sc_impact", sql(f"SELECT b.key, coalesce(i.impact_index, {DEFAULT_IMPACT}::DOUBLE) AS impact_index, b.n FROM (SELECT CASE WHEN user_id % 11 = 10 THEN 'elsewhere' ELSE {a.sql_pick([*sorted(p[0] for p in a.PORTS), 'elsewhere'], 'user_id % 11')} END AS key, count(*) AS n FROM events GROUP BY 1) b LEFT JOIN i ON i.port_id = b.key", "a_ports", i=SQL_IMPACT))
def sc_impact(spark, sf_dir):
    key = a.pick([*sorted(p[0] for p in a.PORTS), "elsewhere"], F.col("user_id") % 11)
    b = a.table(spark, sf_dir, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    i = impact_table(spark).select(F.col("port_id").alias("key"), "impact_index")
    return b.join(F.broadcast(i), "key", "left").select("key", F.coalesce("impact_index", F.lit(DEFAULT_IMPACT)).alias("impact_index"), "n")


LAG_LIKE = [c for c in MODEL_COLUMNS if any(w in c for w in LAG_WORDS)]


def feature_matrix(gold: DataFrame) -> DataFrame:
    """Keys, the model's columns as doubles without nulls, and the stable number of the port (-1 if unknown): lag-like columns
    are filled forward within the port, then all with zeros."""
    enc = s.lookup(F.col("port_id"), {p: i for i, p in enumerate(sorted(x[0] for x in a.PORTS))}, -1)
    filled = [F.coalesce(windows.forward_fill(F.col(c)) if c in LAG_LIKE else F.col(c), F.lit(0)).cast("double").alias(c) for c in MODEL_COLUMNS]
    return gold.select("port_id", "week_ending", *filled, enc.cast("double").alias("port_id_enc"), "is_disruption_week", "data_completeness_score")


_MATRIX = ", ".join(f"round(coalesce({f'last_value({c} IGNORE NULLS) OVER (PARTITION BY port_id ORDER BY week_ending ROWS UNBOUNDED PRECEDING)' if c in LAG_LIKE else c}, 0)::DOUBLE, {0 if 'energy' in c else 6}) AS {c}" for c in MODEL_COLUMNS)


@query("prj_feature_matrix", gold_sql(f"SELECT port_id, week_ending, {_MATRIX}, enc::DOUBLE AS port_id_enc FROM g JOIN a_ports USING (port_id)"))
def prj_feature_matrix(spark, sf_dir):
    return rounded(feature_matrix(gold_frame(spark, sf_dir)).drop("is_disruption_week", "data_completeness_score"), eq_energy_proxy=0)


# Scalar functions ------------------------------------------------------------------------------------------------------


@query("fn_string", "SELECT p_partkey, lower(p_name) AS low, contains(lower(p_type), 'a') AS has_a, starts_with(p_brand, 'B') AS starts, split_part(p_brand, '#', 2) AS last_part, lpad(p_size::VARCHAR, 4, '0') AS padded, left(p_name, 5) AS cut, replace(p_type, ' ', '_') AS replaced, printf('%.1f', p_size / 4.0::DOUBLE) AS one_digit, printf('%+.1f', p_size / 4.0::DOUBLE - 5) AS signed FROM part")
def fn_string(spark, sf_dir):
    p = a.table(spark, sf_dir, "part")
    quarter = F.col("p_size") / F.lit(4.0)
    return p.select(
        "p_partkey", F.lower("p_name").alias("low"), F.lower("p_type").contains("a").alias("has_a"), F.col("p_brand").startswith("B").alias("starts"), F.coalesce(F.get(F.split("p_brand", "#"), F.lit(1)), F.lit("")).alias("last_part"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.substring("p_name", 1, 5).alias("cut"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("replaced"),
        F.format_string("%.1f", F.bround(quarter, 1)).alias("one_digit"), F.format_string("%+.1f", F.bround(quarter - 5, 1)).alias("signed"),
    )


@query("fn_datetime", """SELECT o_orderkey, strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')::DATE AS parsed, date_trunc('day', o_orderdate)::DATE AS floor_day, (o_orderdate + INTERVAL 6 DAY)::DATE AS later, (isodow(o_orderdate) - 1)::INTEGER AS weekday, weekofyear(o_orderdate)::INTEGER AS iso_week,
    strftime(o_orderdate, '%Y-%m') AS year_month, epoch_ms(o_orderdate) AS ms, TRY_CAST(o_orderpriority AS DATE) AS bad FROM orders""")  # fmt: skip
def fn_datetime(spark, sf_dir):
    d = F.col("o_orderdate")
    return a.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.coalesce(F.try_to_date(F.date_format(d, "MM/dd/yyyy"), "yyyy-MM-dd"), F.try_to_date(F.date_format(d, "MM/dd/yyyy"), "MM/dd/yyyy")).alias("parsed"), F.date_trunc("day", d).cast("date").alias("floor_day"),
        F.date_add(d.cast("date"), 6).alias("later"), F.weekday(d).alias("weekday"), F.weekofyear(d).alias("iso_week"), F.date_format(d, "yyyy-MM").alias("year_month"), F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), d).cast("timestamp")).alias("ms"), F.try_to_date("o_orderpriority", "yyyy-MM-dd").alias("bad"),
    )


@query("fn_math", "SELECT l_orderkey, l_linenumber, round(radians(l_quantity), 9) AS rad, round(sin(l_quantity), 9) AS sine, round(asin(sqrt(l_discount)), 9) AS arc, round(pow(10.0::DOUBLE, l_discount), 9) AS power, round(1 / (1 + exp(-l_discount)), 9) AS sigmoid, abs(l_discount - l_tax) AS gap, greatest(0.02::DOUBLE, least(0.06::DOUBLE, l_discount)) AS clipped, round(l_quantity / nullif(l_tax, 0), 6) AS safe FROM lineitem")
def fn_math(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return a.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.radians(q), 9).alias("rad"), F.round(F.sin(q), 9).alias("sine"), F.round(F.asin(F.sqrt(d)), 9).alias("arc"), F.round(F.pow(F.lit(10.0), d), 9).alias("power"),
        F.round(1 / (1 + F.exp(-d)), 9).alias("sigmoid"), F.abs(d - t).alias("gap"), F.greatest(F.lit(0.02), F.least(F.lit(0.06), d)).alias("clipped"), F.round(F.try_divide(q, t), 6).alias("safe"),
    )


@query("fn_array", "SELECT user_id, list_sort(list(event_id))[:3] AS first_three, count(*)::INTEGER AS n, list_filter([CASE WHEN count(*) > 8 THEN 'busy' END, CASE WHEN max(value) > 90 THEN 'large' END], lambda x: x IS NOT NULL) AS flags FROM events GROUP BY user_id")
def fn_array(spark, sf_dir):
    """The three smallest ids are ranked before they are collected, so no user's events are in one list."""
    e = a.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    flags = F.filter(F.array(F.when(F.count("*") > 8, "busy"), F.when(F.max("value") > 90, "large")), lambda x: x.isNotNull())
    counts = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n"), flags.alias("flags"))
    first = windows.top_per_key(e.select("user_id", "event_id"), ["user_id"], 3, F.col("event_id")).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("first_three"))
    return counts.join(first, "user_id").select("user_id", "first_three", "n", "flags")


_CODES = ["14", "141", "144", "145", "146", "172", "173", "174", "201", "20", "999"]
_CODE_SQL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CODES.items()) + " ELSE 'Other' END"


@query("fn_map_lookup", f"SELECT event_id, {_CODE_SQL} AS label FROM (SELECT event_id, {a.sql_pick(_CODES, 'event_id % 11')} AS code FROM events)")
def fn_map_lookup(spark, sf_dir):
    return a.table(spark, sf_dir, "events").select("event_id", s.lookup(a.pick(_CODES, F.col("event_id") % 11), EVENT_CODES, "Other").alias("label"))


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.none') AS missing, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def fn_json(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, none string"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.none").alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("p.k").alias("k"))).alias("packed"))
