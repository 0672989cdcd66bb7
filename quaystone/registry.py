"""Ports, lookup tables and column lists. Results depend on them as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (port_id, name, lat, lon, state, region, nws_zone, TEU in millions, base berthing hours), in registry order.
PORTS = [
    ("la_lb", "Los Angeles / Long Beach", 33.75, -118.25, "CA", "West Coast", "CAZ043", 19.3, 60.0),
    ("ny_nj", "New York / New Jersey", 40.68, -74.05, "NJ", "East Coast", "NJZ006", 8.9, 48.0),
    ("savannah", "Savannah", 32.08, -81.10, "GA", "East Coast", "GAZ099", 5.8, 36.0),
    ("seattle", "Seattle / Tacoma", 47.59, -122.35, "WA", "West Coast", "WAZ551", 3.7, 38.0),
    ("houston", "Houston", 29.75, -95.08, "TX", "Gulf Coast", "TXZ163", 3.2, 42.0),
    ("charleston", "Charleston", 32.78, -79.94, "SC", "East Coast", "SCZ048", 2.8, 30.0),
    ("norfolk", "Norfolk / Hampton Roads", 36.94, -76.29, "VA", "East Coast", "VAZ098", 2.9, 36.0),
    ("oakland", "Oakland", 37.79, -122.27, "CA", "West Coast", "CAZ007", 2.5, 30.0),
    ("miami", "Miami", 25.77, -80.19, "FL", "East Coast", "FLZ072", 1.2, 28.0),
    ("baltimore", "Baltimore", 39.27, -76.61, "MD", "East Coast", "MDZ012", 0.9, 32.0),
]
DEFAULT_IMPACT, DEFAULT_BASE_HOURS = 0.05, 36.0
EARTH_KM = 6371.0
NEWS_KM, HAZARD_KM, MIN_MAGNITUDE = 500.0, 200.0, 4.5

ROOT_CODES = ("14", "17", "20")
EVENT_CODES = {
    "14": "Protest",
    "141": "Demonstrate or rally",
    "144": "Hunger strike",
    "145": "Strike or boycott",
    "146": "Obstruct passage / block",
    "172": "Administrative sanctions",
    "173": "Embargo, boycott, or trade sanctions",
    "174": "Halt negotiations",
    "201": "Impose blockade / restrict movement",
    "20": "Use of conventional military force",
}
SEVERITY_SCORE = {"Extreme": 4, "Severe": 3, "Moderate": 2, "Minor": 1}
ALERT_WORDS = {
    "hurricane": ("hurricane", "typhoon", "tropical storm", "tropical cyclone"),
    "high_wind": ("high wind", "wind advisory", "gale", "windstorm"),
    "flood": ("flood", "storm surge", "coastal flood", "flash flood"),
    "fog": ("dense fog", "fog advisory", "low visibility"),
}
SIGNAL_SEVERITY = {"extreme": "critical", "severe": "high", "moderate": "medium", "minor": "low", "unknown": "low"}
#: Flags that lower a card's confidence, in order; those with a place for it name the share of sources.
CONFIDENCE_FLAGS = {
    "no_model": "no_model_loaded: scoring used fallback heuristics only",
    "low": "low_data_completeness: only {share} of sources contributed",
    "partial": "partial_data: {share} of sources contributed",
    "few": "few_signals: fewer than 2 live signals found in lookback window",
    "no_drivers": "no_shap_drivers: model explanation unavailable",
    "neutral": "anomaly_default: anomaly detector returned neutral score (may lack data)",
}
SEVERITY_ORDER = {"critical": 3, "high": 2, "medium": 1, "low": 0}
ACTIONS = {
    "low": ["Monitor normal operations and scheduled shipments.", "Review weekly BTS port performance updates.", "No immediate contingency action required."],
    "medium": ["Increase safety stock by 10–15% for goods transiting this port.", "Review carrier commitments and request status confirmations.", "Identify backup routing options to alternative ports.", "Brief procurement team on elevated risk level."],
    "high": ["Activate contingency supply plan immediately.", "Re-route time-critical shipments to alternative ports where feasible.", "Engage logistics providers for real-time status updates.", "Notify affected business units and key customers of potential delays.", "Increase monitoring frequency to daily."],
    "critical": ["Escalate to VP Supply Chain — immediate leadership awareness required.", "Authorise emergency sourcing from alternative suppliers.", "Suspend new bookings through this port until situation stabilises.", "Notify key customers of confirmed or likely delays.", "Convene crisis response team within 24 hours."],
}

#: Columns of the wide monthly throughput table, and the port each belongs to; Long Beach is added to Los Angeles.
TEU_COLUMNS = {
    "los_angeles_ca": "la_lb",
    "port_of_ny_nj": "ny_nj",
    "savannah_ga": "savannah",
    "nwsa_seattle_tacoma_wa": "seattle",
    "houston_tx": "houston",
    "charleston_sc": "charleston",
    "port_of_virginia_va": "norfolk",
    "oakland_ca": "oakland",
}

PORT_COLUMNS = ["median_berthing_time_hrs", "avg_berthing_time_hrs", "vessel_call_count", "berthing_time_lag_1w", "berthing_time_lag_2w", "berthing_time_lag_4w", "berthing_time_pct_change_1w", "call_count_pct_change_1w", "berthing_time_4w_avg", "berthing_time_4w_std", "berthing_time_52w_avg", "berthing_time_52w_std", "berthing_time_z_score_52w", "berthing_time_p75_52w"]
CALENDAR_COLUMNS = ["week_of_year", "month", "is_q4"]
WEATHER_COLUMNS = ["alert_count", "extreme_alert_count", "severe_alert_count", "has_hurricane_alert", "has_high_wind_alert", "has_flood_alert", "has_fog_alert", "max_severity_score"]
NEWS_COLUMNS = ["gdelt_event_count", "gdelt_strike_count", "gdelt_coerce_count", "gdelt_conflict_count", "gdelt_goldstein_avg", "gdelt_goldstein_min", "gdelt_avg_tone", "gdelt_num_articles_total", "gdelt_num_mentions_total", "gdelt_weighted_disruption"]
QUAKE_COLUMNS = ["eq_count", "eq_max_magnitude", "eq_energy_proxy", "eq_tsunami_flag", "eq_depth_min_km"]
FIRE_COLUMNS = ["fire_count", "fire_high_confidence_count", "fire_max_frp", "fire_total_frp"]
GOLD_COLUMNS = ["port_id", "week_ending", *PORT_COLUMNS, *CALENDAR_COLUMNS, *WEATHER_COLUMNS, *NEWS_COLUMNS, *QUAKE_COLUMNS, *FIRE_COLUMNS, "data_completeness_score", "is_disruption_week"]
ZERO_FILLED = [*WEATHER_COLUMNS, *NEWS_COLUMNS, *QUAKE_COLUMNS[:4], *FIRE_COLUMNS]
#: One column a source whose presence shows that the source contributed.
INDICATORS = ["median_berthing_time_hrs", "alert_count", "gdelt_event_count", "eq_count", "fire_count"]

MODEL_COLUMNS = [
    "berthing_time_lag_1w", "berthing_time_lag_2w", "berthing_time_lag_4w", "berthing_time_pct_change_1w", "call_count_pct_change_1w", "berthing_time_4w_avg", "berthing_time_4w_std", "berthing_time_52w_avg", "berthing_time_52w_std", "berthing_time_z_score_52w",
    "week_of_year", "month", "is_q4", "alert_count", "extreme_alert_count", "severe_alert_count", "has_hurricane_alert", "has_high_wind_alert", "has_flood_alert", "max_severity_score",
    "gdelt_event_count", "gdelt_strike_count", "gdelt_coerce_count", "gdelt_goldstein_avg", "gdelt_goldstein_min", "gdelt_weighted_disruption", "eq_count", "eq_max_magnitude", "eq_energy_proxy", "eq_tsunami_flag", "fire_count", "fire_max_frp",
]
ANOMALY_COLUMNS = ["berthing_time_lag_1w", "berthing_time_pct_change_1w", "berthing_time_z_score_52w", "berthing_time_4w_avg", "alert_count", "gdelt_event_count", "gdelt_weighted_disruption", "eq_count", "fire_count"]
LAG_WORDS = ("lag", "rolling", "z_score", "avg", "std")

#: Gold columns that hold whole numbers; the other measures are doubles.
WHOLE_COLUMNS = ["vessel_call_count", "week_of_year", "month", "is_q4", *WEATHER_COLUMNS, "gdelt_event_count", "gdelt_strike_count", "gdelt_coerce_count", "gdelt_conflict_count", "eq_count", "eq_tsunami_flag", "fire_count", "fire_high_confidence_count", "is_disruption_week"]

PORT_SCHEMA = "ord int, enc int, port_id string, name string, lat double, lon double, state string, region string, nws_zone string, teu_m double, base_hrs double"
PORT_IDS = [p[0] for p in PORTS]
SORTED_IDS = sorted(PORT_IDS)


def port_rows() -> list[tuple]:
    return [(i, SORTED_IDS.index(p[0]), *p) for i, p in enumerate(PORTS)]


def ports(spark: SparkSession) -> DataFrame:
    """The ten ports: ord is the registry order, enc the place among the sorted ids."""
    return spark.createDataFrame(port_rows(), PORT_SCHEMA)
