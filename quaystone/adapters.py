"""Views that give the driver's tables the shapes of the feeds, as DataFrames and as DuckDB CTEs with the same rows.

Integer arithmetic only, so both give the same values. Events lie 8400 days (1200 weeks) after the span of the orders; shifting
them back keeps weekdays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.scalar import week_ending
from quaystone.operators.geo import with_nearest_port
from quaystone.registry import HAZARD_KM, NEWS_KM, PORTS, ROOT_CODES, SORTED_IDS, port_rows, ports

SHIFT = "INTERVAL 8400 DAY"
SEVERITIES = ["Unknown", "Minor", "Moderate", "Severe", "Extreme"]
EVENT_TYPES = ["High Wind Warning", "Hurricane Warning", "Flood Advisory", "Dense Fog Advisory", "Tornado Warning", "Tropical Storm Watch"]
ROOTS = {"1": "14", "2": "17", "3": "20", "4": "19", "5": "04"}
CONFIDENCES = ["low", "nominal", "high"]
AS_OF = "2001-01-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[({index})::INTEGER + 1]"


def a_ports(spark, sf_dir) -> DataFrame:
    return ports(spark)


def _lat(key: str) -> Column:
    return 24 + ((F.col(key) * 7919) % 2600).cast("double") / 100


def _lon(key: str) -> Column:
    return -125 + ((F.col(key) * 104729) % 6000).cast("double") / 100


def a_bts(spark, sf_dir) -> DataFrame:
    """Weekly throughput of a port: suppliers are dealt to ports by their key."""
    rows = table(spark, sf_dir, "lineitem").select(pick(SORTED_IDS, F.col("l_suppkey") % 10).alias("port_id"), week_ending(F.col("l_shipdate")).alias("week_ending"), "l_quantity", "l_orderkey", "l_shipdate")
    return rows.groupBy("port_id", "week_ending").agg(
        F.median("l_quantity").alias("median_berthing_time_hrs"), F.avg("l_quantity").alias("avg_berthing_time_hrs"), F.count_distinct("l_orderkey").cast("int").alias("vessel_call_count"),
        (F.count("*") * 100).alias("teu_count"), F.max("l_shipdate").alias("ingested_at"),
    )


def a_bts_dup(spark, sf_dir) -> DataFrame:
    """a_bts and, for one row in seven, a later version with another median."""
    bts = a_bts(spark, sf_dir)
    later = bts.filter("teu_count % 700 = 0").withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 DAY")).withColumn("median_berthing_time_hrs", F.col("median_berthing_time_hrs") + 1)
    return bts.unionByName(later)


def a_nws(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "view"))
    return e.select(
        F.col("event_id").cast("string").alias("alert_id"), pick(SORTED_IDS, F.col("user_id") % 10).alias("port_id"), pick(EVENT_TYPES, F.col("event_id") % 6).alias("event_type"),
        pick(SEVERITIES, F.col("event_id") % 5).alias("severity"), (F.col("ts") - F.expr(SHIFT)).alias("effective"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id",
    )


def a_gdelt_raw(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    root = F.element_at(F.create_map(*[F.lit(x) for kv in ROOTS.items() for x in kv]), F.substring("o_orderpriority", 1, 1))
    return o.select(
        F.col("o_orderkey").alias("global_event_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("sql_date"), F.concat(root, (F.col("o_orderkey") % 7).cast("string")).alias("event_code"), root.alias("event_root_code"),
        (((F.col("o_orderkey") * 37) % 201).cast("double") / 10 - 10).alias("goldstein_scale"), (F.col("o_custkey") % 50).alias("num_mentions"), (F.col("o_custkey") % 20).alias("num_articles"),
        (((F.col("o_orderkey") * 13) % 101).cast("double") / 10 - 5).alias("avg_tone"), F.when(F.col("o_orderkey") % 17 != 0, _lat("o_orderkey")).alias("lat"), _lon("o_orderkey").alias("lon"),
    )


def a_gdelt(spark, sf_dir) -> DataFrame:
    """Disruption news near a port."""
    raw = a_gdelt_raw(spark, sf_dir).filter(F.col("event_root_code").isin(*ROOT_CODES))
    return with_nearest_port(raw, NEWS_KM)


def a_usgs_raw(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select(
        F.col("event_id").cast("string").alias("usgs_id"), (3.5 + (F.col("event_id") % 40).cast("double") / 10).alias("magnitude"), (F.col("event_id") % 70).cast("double").alias("depth_km"),
        (F.col("event_id") % 11 == 0).alias("tsunami_flag"), _lat("event_id").alias("lat"), _lon("event_id").alias("lon"), (F.col("ts") - F.expr(SHIFT)).alias("occurred_at"), "event_id",
    )


def a_usgs(spark, sf_dir) -> DataFrame:
    return with_nearest_port(a_usgs_raw(spark, sf_dir), HAZARD_KM)


def a_firms_raw(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return e.select(
        "event_id", F.col("value").alias("frp"), pick(CONFIDENCES, F.col("event_id") % 3).alias("confidence"), _lat("event_id").alias("lat"), _lon("event_id").alias("lon"), (F.col("ts") - F.expr(SHIFT)).alias("acquired_at")
    )


def a_firms(spark, sf_dir) -> DataFrame:
    return with_nearest_port(a_firms_raw(spark, sf_dir), HAZARD_KM)


def a_preds(spark, sf_dir) -> DataFrame:
    """Predictions: a label and a score for each labelled document."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id").select("doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 1000).cast("double") / 1000).alias("p"), (F.col("doc_id") % 3).cast("int").alias("fold"))


def a_runs(spark, sf_dir) -> DataFrame:
    """Run records: customers as runs, order priorities as sources, order keys as the order of writing."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_orderkey") % 3).cast("int").alias("errors"), (F.col("o_orderkey") % 5).cast("int").alias("records_stored"), F.col("o_orderkey").alias("seq"),
    )


def a_models(spark, sf_dir) -> DataFrame:
    """Model versions: one a day of orders, the first key of the day."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("trained_at")).agg(F.min("o_orderkey").alias("k"))
    return first.select(F.concat(F.lit("v"), "k").alias("version"), "trained_at", (((F.col("k") * 37) % 1000).cast("double") / 1000).alias("pr_auc"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def _km(lat: str, lon: str, plat: str = "p.lat", plon: str = "p.lon") -> str:
    return f"2 * 6371.0 * asin(sqrt(pow(sin(radians({lat} - {plat}) / 2), 2) + cos(radians({plat})) * cos(radians({lat})) * pow(sin(radians({lon} - {plon}) / 2), 2)))"


def _nearest(source: str, km: float, key: str) -> str:
    return f"""SELECT * EXCLUDE (rk) FROM (SELECT r.*, p.port_id, {_km('r.lat', 'r.lon')} AS distance_km,
        row_number() OVER (PARTITION BY r.{key} ORDER BY {_km('r.lat', 'r.lon')}, p.ord) AS rk FROM {source} r, a_ports p WHERE r.lat IS NOT NULL AND r.lon IS NOT NULL)
        WHERE rk = 1 AND distance_km <= {km}"""


def _sql_where(key: str) -> tuple[str, str]:
    return f"24 + (({key} * 7919) % 2600)::DOUBLE / 100", f"-125 + (({key} * 104729) % 6000)::DOUBLE / 100"


def sql_week(ts: str) -> str:
    return f"(date_trunc('week', {ts}) + INTERVAL 6 DAY)::DATE"


_EVENT_LAT, _EVENT_LON = _sql_where("event_id")
_ORDER_LAT, _ORDER_LON = _sql_where("o_orderkey")
_ROOT_SQL = "CASE left(o_orderpriority, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROOTS.items()) + " END"

#: name: (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "a_ports": ((), f"SELECT * FROM (VALUES {_values(port_rows())}) t(ord, enc, port_id, name, lat, lon, state, region, nws_zone, teu_m, base_hrs)"),
    "a_bts": ((), f"""SELECT {sql_pick(SORTED_IDS, 'l_suppkey % 10')} AS port_id, {sql_week('l_shipdate')} AS week_ending, median(l_quantity) AS median_berthing_time_hrs,
        avg(l_quantity) AS avg_berthing_time_hrs, count(DISTINCT l_orderkey)::INTEGER AS vessel_call_count, count(*) * 100 AS teu_count, max(l_shipdate) AS ingested_at FROM lineitem GROUP BY 1, 2"""),
    "a_bts_dup": (("a_bts",), """SELECT * FROM a_bts UNION ALL SELECT port_id, week_ending, median_berthing_time_hrs + 1, avg_berthing_time_hrs, vessel_call_count, teu_count, ingested_at + INTERVAL 1 DAY FROM a_bts WHERE teu_count % 700 = 0"""),
    "a_nws": ((), f"""SELECT event_id::VARCHAR AS alert_id, {sql_pick(SORTED_IDS, 'user_id % 10')} AS port_id, {sql_pick(EVENT_TYPES, 'event_id % 6')} AS event_type,
        {sql_pick(SEVERITIES, 'event_id % 5')} AS severity, ts - {SHIFT} AS effective, json_extract_string(props, '$.k')::INTEGER AS k, event_id FROM events WHERE event_type IN ('error', 'view')"""),
    "a_gdelt_raw": ((), f"""SELECT o_orderkey AS global_event_id, strftime(o_orderdate, '%Y%m%d') AS sql_date, {_ROOT_SQL} || (o_orderkey % 7)::VARCHAR AS event_code, {_ROOT_SQL} AS event_root_code,
        ((o_orderkey * 37) % 201)::DOUBLE / 10 - 10 AS goldstein_scale, o_custkey % 50 AS num_mentions, o_custkey % 20 AS num_articles, ((o_orderkey * 13) % 101)::DOUBLE / 10 - 5 AS avg_tone,
        CASE WHEN o_orderkey % 17 <> 0 THEN {_ORDER_LAT} END AS lat, {_ORDER_LON} AS lon FROM orders"""),
    "a_gdelt_codes": (("a_gdelt_raw",), f"SELECT * FROM a_gdelt_raw WHERE event_root_code IN {ROOT_CODES}"),
    "a_gdelt": (("a_ports", "a_gdelt_codes"), _nearest("a_gdelt_codes", NEWS_KM, "global_event_id")),
    "a_usgs_raw": ((), f"""SELECT event_id::VARCHAR AS usgs_id, 3.5 + (event_id % 40)::DOUBLE / 10 AS magnitude, (event_id % 70)::DOUBLE AS depth_km, event_id % 11 = 0 AS tsunami_flag,
        {_EVENT_LAT} AS lat, {_EVENT_LON} AS lon, ts - {SHIFT} AS occurred_at, event_id FROM events WHERE event_type = 'click'"""),
    "a_usgs": (("a_ports", "a_usgs_raw"), _nearest("a_usgs_raw", HAZARD_KM, "usgs_id")),
    "a_firms_raw": ((), f"""SELECT event_id, value AS frp, {sql_pick(CONFIDENCES, 'event_id % 3')} AS confidence, {_EVENT_LAT} AS lat, {_EVENT_LON} AS lon, ts - {SHIFT} AS acquired_at
        FROM events WHERE event_type = 'purchase'"""),
    "a_firms": (("a_ports", "a_firms_raw"), _nearest("a_firms_raw", HAZARD_KM, "event_id")),
    "a_preds": ((), "SELECT doc_id, quality AS y, (n_chars % 1000)::DOUBLE / 1000 AS p, (doc_id % 3)::INTEGER AS fold FROM documents JOIN labels USING (doc_id)"),
    "a_runs": ((), """SELECT o_custkey AS run_id, o_orderpriority AS source, o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at, o_orderstatus AS status,
        CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_orderkey % 3 END::INTEGER AS errors, (o_orderkey % 5)::INTEGER AS records_stored, o_orderkey AS seq FROM orders"""),
    "a_models": ((), "SELECT 'v' || k AS version, trained_at, ((k * 37) % 1000)::DOUBLE / 1000 AS pr_auc FROM (SELECT o_orderdate::DATE AS trained_at, min(o_orderkey) AS k FROM orders GROUP BY 1)"),
}


def sql(body: str, *views: str, **more: str) -> str:
    """body with the CTEs of the views it reads, and of `more` (in order, after them)."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    ctes = [f"{v} AS ({VIEWS[v][1]})" for v in order] + [f"{k} AS ({v})" for k, v in more.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


__all__ = [n for n in dir() if n.startswith("a_")] + ["sql", "sql_week", "table", "pick", "VIEWS", "PORTS", "AS_OF"]
