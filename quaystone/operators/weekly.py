"""Events to weekly features by port, the dense spine, and the gold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.scalar import has_word, lenient, lookup, sql_date, week_ending
from quaystone.registry import ALERT_WORDS, GOLD_COLUMNS, INDICATORS, SEVERITY_SCORE, WHOLE_COLUMNS, ZERO_FILLED

KEYS = ["port_id", "week_ending"]


def weekly(df: DataFrame, ts, *aggregates) -> DataFrame:
    """Aggregates by port and week; rows without a port or a date are left out."""
    keyed = df.withColumn("week_ending", week_ending(ts)).filter("port_id IS NOT NULL AND week_ending IS NOT NULL")
    return keyed.groupBy(*KEYS).agg(*aggregates)


def weather_aggregates() -> list:
    score = lookup(F.col("severity"), SEVERITY_SCORE, 0)
    flags = [F.max(has_word(F.col("event_type"), words)).alias(f"has_{name}_alert") for name, words in ALERT_WORDS.items()]
    return [F.count("alert_id").alias("alert_count"), F.count_if(score == 4).alias("extreme_alert_count"), F.count_if(score == 3).alias("severe_alert_count"), *flags, F.max(score).alias("max_severity_score")]


def weather_weekly(alerts: DataFrame) -> DataFrame:
    """alert_id, port_id, event_type, severity, effective"""
    return weekly(alerts, F.col("effective"), *weather_aggregates())


def news_weekly(news: DataFrame) -> DataFrame:
    """global_event_id, port_id, sql_date, event_root_code, goldstein_scale, num_mentions, num_articles, avg_tone"""
    g, m = lenient(F.col("goldstein_scale")), lenient(F.col("num_mentions"))
    coded = lambda code: F.count_if(F.col("event_root_code") == code)
    return weekly(
        news, sql_date(F.col("sql_date")),
        F.count("global_event_id").alias("gdelt_event_count"), coded("14").alias("gdelt_strike_count"), coded("17").alias("gdelt_coerce_count"), coded("20").alias("gdelt_conflict_count"),
        F.avg(g).alias("gdelt_goldstein_avg"), F.min(g).alias("gdelt_goldstein_min"), F.avg(lenient(F.col("avg_tone"))).alias("gdelt_avg_tone"),
        F.sum(lenient(F.col("num_articles"))).alias("gdelt_num_articles_total"), F.sum(m).alias("gdelt_num_mentions_total"),
        F.sum(F.when(g < 0, -g * m).otherwise(0.0)).alias("gdelt_weighted_disruption"),
    )


def quake_weekly(quakes: DataFrame) -> DataFrame:
    """usgs_id, port_id, magnitude, depth_km, tsunami_flag, occurred_at"""
    mag = lenient(F.col("magnitude"))
    return weekly(
        quakes, F.col("occurred_at"),
        F.count("usgs_id").alias("eq_count"), F.max(mag).alias("eq_max_magnitude"), F.sum(F.pow(F.lit(10.0), 1.5 * mag)).alias("eq_energy_proxy"),
        F.max(F.coalesce(F.col("tsunami_flag").cast("int"), F.lit(0))).alias("eq_tsunami_flag"), F.min(F.col("depth_km").try_cast("double")).alias("eq_depth_min_km"),
    )


def fire_weekly(fires: DataFrame) -> DataFrame:
    """port_id, frp, confidence, acquired_at"""
    frp = lenient(F.col("frp"))
    return weekly(fires, F.col("acquired_at"), F.count("*").alias("fire_count"), F.count_if(F.col("confidence") == "high").alias("fire_high_confidence_count"), F.max(frp).alias("fire_max_frp"), F.sum(frp).alias("fire_total_frp"))


#: Weeks of the spine where there is no throughput.
FALLBACK_WEEKS = 104


def _every_sunday(ports: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every port with every Sunday from a to b. Both sides are a few rows: ports, and one row of bounds."""
    sundays = bounds.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_ending"))
    return sundays.crossJoin(F.broadcast(ports.select("port_id"))).select(*KEYS)


def spine(ports: DataFrame, weeks: DataFrame) -> DataFrame:
    """Every port with every Sunday between the first and last week."""
    return _every_sunday(ports, weeks.agg(F.min("week_ending").alias("a"), F.max("week_ending").alias("b")).filter("a IS NOT NULL"))


def gold_spine(ports: DataFrame, weeks: DataFrame, as_of: str | None = None) -> DataFrame:
    """spine(); without any week, with the last FALLBACK_WEEKS up to the week of as_of (today)."""
    end = week_ending(F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp"))
    first, last = F.coalesce(F.min("week_ending"), F.date_sub(end, 7 * (FALLBACK_WEEKS - 1))), F.coalesce(F.max("week_ending"), end)
    return _every_sunday(ports, weeks.agg(first.alias("a"), last.alias("b")))


def fallback_spine(ports: DataFrame, as_of: str, weeks: int = FALLBACK_WEEKS) -> DataFrame:
    """Every port with the last weeks up to the week of as_of."""
    end = week_ending(F.lit(as_of).cast("timestamp"))
    sundays = ports.select("port_id", F.explode(F.sequence(F.date_sub(end, 7 * (weeks - 1)), end, F.expr("interval 7 days"))).alias("week_ending"))
    return sundays.select(*KEYS)


def canonical(df: DataFrame) -> DataFrame:
    """The gold table's columns in their order; what df lacks is null."""
    kind = lambda c: "string" if c == "port_id" else "date" if c == "week_ending" else "int" if c in WHOLE_COLUMNS else "double"
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind(c)).alias(c) for c in GOLD_COLUMNS])


def _completeness(has_throughput, present: list) -> Column:
    return F.round((has_throughput.cast("int") + sum(present[1:], present[0])) / len(INDICATORS), 3)


def assembled(keys: DataFrame, sides: list[DataFrame], flags: list[Column]) -> DataFrame:
    """Gold rows of the keys from throughput features and the weekly aggregates of four feeds. flags: whether each of the four has
    rows anywhere."""
    out = keys
    for side in sides:
        out = out.join(side, KEYS, "left")
    out = out.fillna(0, subset=[c for c in ZERO_FILLED if c in out.columns])
    return canonical(out.withColumn("data_completeness_score", _completeness(F.col(INDICATORS[0]).isNotNull(), flags)))


def gold(ports: DataFrame, port: DataFrame, weather: DataFrame, news: DataFrame, quakes: DataFrame, fires: DataFrame, as_of: str | None = None) -> DataFrame:
    """The feature table, one row a port and week; without throughput rows, of the last weeks up to as_of. A source without rows
    anywhere contributes to no row's completeness; one with rows contributes to all, as its counts are filled with zeros first."""
    events = [weather, news, quakes, fires]
    # Whether a source has rows. All its columns are named, so that this reads the rows that are shuffled for the join anyway.
    some = lambda side, name: side.agg(F.max(F.xxhash64(*side.columns)).isNotNull().cast("int").alias(name))
    keys = gold_spine(ports, port, as_of)
    present = [some(side, f"s{i}") for i, side in enumerate(events, 1)]
    flags = present[0].crossJoin(present[1]).crossJoin(present[2]).crossJoin(present[3])  # one row each
    return assembled(keys.crossJoin(F.broadcast(flags)), [port, *events], [F.col(f"s{i}") for i in range(1, 5)])


def newest(ports: DataFrame, throughput: DataFrame, sources: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Week and completeness of each port's newest gold row, without the gold table: port_id, features_week_ending,
    data_completeness. throughput has a row a port and week; sources: rows and week of the four event feeds, of which one row each is read."""
    last = throughput.agg(F.max("week_ending").alias("features_week_ending")).filter("features_week_ending IS NOT NULL")
    # A port without a row in that week has a row in the gold table all the same.
    known = throughput.join(F.broadcast(last), F.col("week_ending") == F.col("features_week_ending"), "left_semi").groupBy("port_id").agg((F.count(INDICATORS[0]) > 0).alias("has"))
    out = ports.select("port_id").crossJoin(F.broadcast(last)).join(F.broadcast(known), "port_id", "left")  # ten ports, one week
    flags = []
    for name, (rows, ts) in sources.items():
        one = rows.filter(F.col("port_id").isNotNull() & week_ending(ts).isNotNull()).select(F.lit(1)).limit(1).agg(F.count("*").cast("int").alias(f"s_{name}"))
        out = out.crossJoin(F.broadcast(one))  # one row
        flags.append(F.col(f"s_{name}"))
    return out.select("port_id", "features_week_ending", _completeness(F.coalesce("has", F.lit(False)), flags).alias("data_completeness"))
