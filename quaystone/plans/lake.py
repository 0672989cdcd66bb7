"""Sources, sinks and logs: rows are written in the raw shape of each feed and read back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.adapters import sql
from quaystone.plans.registry import query
from quaystone.registry import TEU_COLUMNS
from quaystone.sources import feeds, footers, lake

#: Features of a GeoJSON page, about.
PAGE_ROWS = 500
_ALERT = "alert_id:string, port_id:string, event_type:string, severity:string, effective:string"


def _alert_rows(spark, sf_dir):
    n = a.a_nws(spark, sf_dir)
    return n.select("alert_id", "port_id", "event_type", "severity", F.date_format("effective", "yyyy-MM-dd'T'HH:mm:ss").alias("effective"))


_ALERT_SQL = "SELECT alert_id, port_id, event_type, severity, strftime(effective, '%Y-%m-%dT%H:%M:%S') AS effective FROM a_nws"


@query("src_bronze_json", sql(_ALERT_SQL, "a_nws"))
def src_bronze_json(spark, sf_dir):
    """Envelopes in one line and over several lines, read back together."""
    rows, root = _alert_rows(spark, sf_dir), lake.scratch(spark)
    half = F.pmod(F.xxhash64("alert_id"), F.lit(2)) == 0
    lake.write_envelopes(rows.filter(half), root, "nws")
    return lake.read_envelopes(spark, lake.write_envelopes(rows.filter(~half), root, "nws", indented=True), _ALERT)


@query("src_bronze_parquet", sql("SELECT *, 2 AS snapshots FROM (SELECT global_event_id, sql_date, event_code, goldstein_scale FROM a_gdelt_raw)", "a_gdelt_raw"))
def src_bronze_parquet(spark, sf_dir):
    """Two snapshots, read back together."""
    rows = a.a_gdelt_raw(spark, sf_dir).select("global_event_id", "sql_date", "event_code", "goldstein_scale")
    root = lake.scratch(spark)
    lake.write_snapshot_parquet(rows, root, "gdelt")
    path = lake.write_snapshot_parquet(rows, root, "gdelt")
    return spark.read.schema(rows.schema).parquet(path).groupBy(*rows.columns).agg(F.count("*").cast("int").alias("snapshots"))


@query("src_typed_read", sql("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('second', effective) END AS effective, right('00000000' || event_id::VARCHAR, 8) AS sql_date, (effective)::DATE AS week_ending FROM a_nws", "a_nws"))
def src_typed_read(spark, sf_dir):
    """Text columns from JSON lines to types; what doesn't parse is null."""
    text = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("effective", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = a.a_nws(spark, sf_dir).select("event_id", text.alias("effective"), F.col("event_id").cast("string").alias("sql_date"), F.date_format("effective", "yyyy-MM-dd").alias("week_ending"))
    path = lake.write_snapshot_json(rows, lake.scratch(spark), "nws", "2001-01-30")
    raw = spark.read.schema("event_id long, effective string, sql_date string, week_ending string, source string, ingest_date date").json(path).filter("source = 'nws'")
    return raw.select("event_id", F.to_timestamp_ntz(F.when(F.col("effective").rlike(r"^\d{4}-"), F.col("effective"))).alias("effective"), F.lpad("sql_date", 8, "0").alias("sql_date"), F.try_to_date("week_ending", "yyyy-MM-dd").alias("week_ending"))


@query("src_typed_quakes", sql("SELECT usgs_id, CASE WHEN event_id % 7 <> 0 THEN magnitude END AS magnitude, depth_km, lat, lon, tsunami_flag, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', occurred_at) END AS occurred_at FROM a_usgs_raw", "a_usgs_raw"))
def src_typed_quakes(spark, sf_dir):
    """Earthquakes as text, some of it bad, to types."""
    q = a.a_usgs_raw(spark, sf_dir)
    text = [F.col(c).cast("string").alias(c) for c in ("depth_km", "lat", "lon", "tsunami_flag")]
    magnitude = F.when(F.col("event_id") % 7 == 0, "strong").otherwise(F.col("magnitude").cast("string"))
    at = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = q.select("usgs_id", magnitude.alias("magnitude"), *text, at.alias("occurred_at"))
    path = lake.write_snapshot_json(rows, lake.scratch(spark), "usgs", "2001-01-30")
    found = feeds.typed_quakes(spark.read.schema(", ".join(f"{c} string" for c in rows.columns)).json(path))
    return found.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query("src_typed_fires", sql("SELECT lat, lon, CASE WHEN event_id % 7 <> 0 THEN frp END AS frp, confidence, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', acquired_at) END AS acquired_at FROM a_firms_raw", "a_firms_raw"))
def src_typed_fires(spark, sf_dir):
    """Fire detections as text, some of it bad, to types."""
    f = a.a_firms_raw(spark, sf_dir)
    frp = F.when(F.col("event_id") % 7 == 0, "bright").otherwise(F.col("frp").cast("string"))
    at = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss"))
    rows = f.select(F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), frp.alias("frp"), F.upper("confidence").alias("confidence"), at.alias("acquired_at"))
    path = lake.write_snapshot_json(rows, lake.scratch(spark), "firms", "2001-01-30")
    found = feeds.typed_fires(spark.read.schema(", ".join(f"{c} string" for c in rows.columns)).json(path))
    return found.withColumn("acquired_at", F.col("acquired_at").cast("timestamp_ntz"))


@query("src_availability", sql("SELECT 'nws' AS source, count(*) AS n FROM a_nws UNION ALL SELECT 'gdelt', count(*) FROM a_gdelt_raw UNION ALL SELECT 'bts', count(*) FROM a_bts UNION ALL SELECT 'usgs', count(*) FROM a_usgs_raw UNION ALL SELECT 'firms', count(*) FROM a_firms_raw", "a_nws", "a_gdelt_raw", "a_bts", "a_usgs_raw", "a_firms_raw"))
def src_availability(spark, sf_dir):
    """Rows by source; without any the job stops."""
    views = {"nws": a.a_nws, "gdelt": a.a_gdelt_raw, "bts": a.a_bts, "usgs": a.a_usgs_raw, "firms": a.a_firms_raw}
    return lake.stop_if_empty(lake.availability({k: v(spark, sf_dir) for k, v in views.items()}))


_NEWS_GIVEN = {"GlobalEventID": "global_event_id", "SQLDATE": "sql_date", "EventCode": "event_code", "EventRootCode": "event_root_code", "GoldsteinScale": "goldstein_scale", "NumMentions": "num_mentions", "NumArticles": "num_articles", "AvgTone": "avg_tone", "ActionGeo_Lat": "lat", "ActionGeo_Long": "lon"}


def _news_lines(spark, sf_dir):
    """Lines of 58 columns, and some that are cut short."""
    r = a.a_gdelt_raw(spark, sf_dir)
    cells = [F.coalesce(F.col(_NEWS_GIVEN[c]).cast("string"), F.lit("")) if c in _NEWS_GIVEN else F.lit("") for c in feeds.NEWS_COLUMNS]
    return r.select(F.concat_ws("\t", *cells).alias("value")).union(r.filter("global_event_id % 50 = 0").select(F.lit("cut\tshort")))


@query("src_gdelt_tsv", sql("SELECT global_event_id AS GlobalEventID, sql_date AS SQLDATE, event_code AS EventCode, event_root_code AS EventRootCode, goldstein_scale AS GoldsteinScale, num_mentions AS NumMentions, num_articles AS NumArticles, avg_tone AS AvgTone, lat AS ActionGeo_Lat, lon AS ActionGeo_Long FROM a_gdelt_raw", "a_gdelt_raw"))
def src_gdelt_tsv(spark, sf_dir):
    """58 columns without a header, and lines that are cut short."""
    path = f"{lake.scratch(spark)}/news"
    _news_lines(spark, sf_dir).write.text(path)
    return feeds.read_news_tsv(spark, path).filter("GlobalEventID IS NOT NULL").select(*_NEWS_GIVEN)


#: Lines of a zip file of the news export, at most; a task holds so many.
ZIP_LINES = 50_000


def _zipped(folder: str, most: int = ZIP_LINES):
    """Writes lines as zips of two members, of at most so many lines each; returns the files' names."""

    def run(batches):
        import io
        import uuid
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)

        def put(lines):
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                for i in (0, 1):
                    z.writestr(f"{i}.export.CSV", "".join(x + "\n" for x in lines[i::2]))
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(packed.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        lines = []
        for batch in batches:
            column = batch.column("value")
            for start in range(0, len(column), most):
                for x in column.slice(start, most).to_pylist():
                    lines.append(x)
                    if len(lines) == most:
                        yield put(lines)
                        lines = []
        if lines:
            yield put(lines)

    return run


@query("src_gdelt_zip", sql("SELECT global_event_id AS GlobalEventID, sql_date AS SQLDATE, event_code AS EventCode, event_root_code AS EventRootCode, goldstein_scale AS GoldsteinScale, num_mentions AS NumMentions, num_articles AS NumArticles, avg_tone AS AvgTone, lat AS ActionGeo_Lat, lon AS ActionGeo_Long FROM a_gdelt_raw", "a_gdelt_raw"))
def src_gdelt_zip(spark, sf_dir):
    """The news export as it is published: zip files of several members; lines that are cut short go."""
    lines, root = _news_lines(spark, sf_dir), lake.scratch(spark)
    # A file that a task wrote before it ran again isn't named by its result.
    names = [r["name"] for r in lines.mapInArrow(_zipped(f"{root}/news"), "name string").collect()]  # a row for ZIP_LINES lines
    return feeds.read_news_zip(spark, [f"{root}/news/{n}" for n in names]).filter("GlobalEventID IS NOT NULL").select(*_NEWS_GIVEN)


@query("src_firms_csv", sql("SELECT lat, lon, CASE WHEN event_id % 10 = 0 THEN NULL ELSE frp END AS frp, CASE WHEN event_id % 8 = 0 THEN 'nominal' ELSE confidence END AS confidence, date_trunc('minute', acquired_at) AS acquired_at FROM a_firms_raw", "a_firms_raw"))
def src_firms_csv(spark, sf_dir):
    f = a.a_firms_raw(spark, sf_dir)
    mark = F.when(F.col("event_id") % 8 == 0, "").otherwise(F.substring("confidence", 1, 1))
    hhmm = F.date_format("acquired_at", "HHmm").cast("int").cast("string")
    raw = f.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("300").alias("brightness"), F.date_format("acquired_at", "yyyy-MM-dd").alias("acq_date"), hhmm.alias("acq_time"), F.lit("N").alias("satellite"), mark.alias("confidence"), F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.col("frp").cast("string")).alias("frp"))
    path = f"{lake.scratch(spark)}/fires"
    raw.write.option("header", True).csv(path)
    return feeds.read_fire_csv(spark, path).select("lat", "lon", "frp", "confidence", F.col("acquired_at").cast("timestamp_ntz").alias("acquired_at"))


def _pages(rows, feature):
    """rows as GeoJSON texts of about PAGE_ROWS features each, however many rows there are."""
    page = F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(max(1, -(-rows.count() // PAGE_ROWS))))
    return rows.select(page.alias("page"), feature.alias("f")).groupBy("page").agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct("features")).alias("value"))


@query("src_nws_geojson", sql("SELECT alert_id, event_type, severity, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Take care' END AS headline, length(repeat('very long text ', (event_id % 90)::INTEGER)[:1000])::INTEGER AS description_chars, date_trunc('second', effective) AS effective FROM a_nws WHERE severity <> 'Unknown'", "a_nws"))
def src_nws_geojson(spark, sf_dir):
    n = a.a_nws(spark, sf_dir)
    at = F.date_format("effective", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    early = F.col("event_id") % 2 == 0
    props = F.struct(F.col("event_type").alias("event"), "severity", F.when(F.col("event_id") % 3 == 0, "").otherwise("Take care").alias("headline"), F.expr("repeat('very long text ', int(event_id % 90))").alias("description"), F.when(early, at).alias("effective"), at.alias("onset"))
    feature = F.struct(F.concat(F.lit("https://feed.example/alerts/"), "alert_id").alias("id"), props.alias("properties"))
    found = feeds.parse_alerts(_pages(n, feature))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("effective").cast("timestamp_ntz"))
    return found.select("alert_id", "event_type", "severity", "headline", F.char_length("description").alias("description_chars"), utc.alias("effective"))


@query("src_usgs_geojson", sql("SELECT usgs_id, magnitude, 'unknown' AS mag_type, depth_km, lat, lon, date_trunc('second', occurred_at) AS occurred_at, tsunami_flag FROM a_usgs_raw WHERE event_id % 6 <> 0", "a_usgs_raw"))
def src_usgs_geojson(spark, sf_dir):
    q = a.a_usgs_raw(spark, sf_dir)
    ms = F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("occurred_at")).cast("timestamp")) * 1000
    whole = F.col("event_id") % 6 != 0
    props = F.struct(F.when(whole, F.col("magnitude")).alias("mag"), ms.alias("time"), F.col("tsunami_flag").cast("int").alias("tsunami"))
    feature = F.struct(F.col("usgs_id").alias("id"), props.alias("properties"), F.struct(F.array("lon", "lat", "depth_km").alias("coordinates")).alias("geometry"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("occurred_at").cast("timestamp_ntz"))
    return feeds.parse_quakes(_pages(q, feature)).select("usgs_id", "magnitude", "mag_type", "depth_km", "lat", "lon", utc.alias("occurred_at"), "tsunami_flag")


_WIDE = [*TEU_COLUMNS, "long_beach_ca"]


def _wide(spark, sf_dir):
    """Months by 9 columns: suppliers are dealt to columns; the date is in one of three forms."""
    l = a.table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("m"), (F.col("l_suppkey") % 9).alias("c"), "l_quantity")
    sums = l.groupBy("m").agg(*[F.sum(F.when(F.col("c") == i, F.col("l_quantity"))).cast("string").alias(name) for i, name in enumerate(_WIDE)])
    form = F.month("m") % 3
    text = F.when(form == 0, F.date_format("m", "M/d/yyyy")).when(form == 1, F.date_format("m", "yyyy-MM-dd")).otherwise(F.date_format("m", "yyyy-MM-dd'T'00:00:00.000"))
    return sums.withColumn("port", text).drop("m")


_WIDE_SQL = "SELECT date_trunc('month', l_shipdate)::DATE AS month, l_suppkey % 9 AS c, sum(l_quantity) AS teu FROM lineitem GROUP BY 1, 2"


_TEU_PORT = "CASE c " + " ".join(f"WHEN {i} THEN '{TEU_COLUMNS.get(n, 'la_lb')}'" for i, n in enumerate(_WIDE)) + " END"


@query("src_teu_unpivot", f"SELECT month, port_id, sum(teu) AS teu FROM (SELECT month, {_TEU_PORT} AS port_id, teu FROM ({_WIDE_SQL})) GROUP BY 1, 2 HAVING sum(teu) > 0")
def src_teu_unpivot(spark, sf_dir):
    return feeds.melt_teu(_wide(spark, sf_dir)).select("month", "port_id", "teu")


@query("sql_param_query", "SELECT event_type, count(*) AS n FROM events WHERE value >= 20 AND event_type <> 'error' GROUP BY event_type")
def sql_param_query(spark, sf_dir):
    """SQL text over lake views, with bound parameters."""
    return spark.sql("SELECT event_type, count(*) AS n FROM {events} WHERE value >= :least AND event_type <> :kind GROUP BY event_type", args={"least": 20, "kind": "error"}, events=a.table(spark, sf_dir, "events"))


@query("sql_lake_query", sql("SELECT e.event_type, o.status, count(*) AS n, round(sum(e.value), 6) AS total FROM events e JOIN (SELECT * FROM r WHERE records_stored >= 2) o ON e.user_id = o.run_id WHERE e.value >= 20 GROUP BY ALL", "a_runs", r="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, finished_at DESC NULLS LAST, source DESC, status DESC) AS rk FROM a_runs) WHERE rk = 1"))
def sql_lake_query(spark, sf_dir):
    """SQL text over the lake's tables by their names, with bound parameters."""
    root = lake.scratch(spark)
    lake.write_silver(a.table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date")), root, "events")
    lake.record_runs(a.a_runs(spark, sf_dir), root)
    # Doubles added one by one are off in the sixth digit after some million; decimals are exact in any order.
    exact = "CAST(sum(TRY_CAST(e.value AS DECIMAL(38, 12))) AS DOUBLE)"
    total = f"CASE WHEN coalesce(max(abs(e.value)), 0) < 1e14D THEN {exact} ELSE sum(e.value) END"
    text = f"SELECT e.event_type, o.status, count(*) AS n, round({total}, 6) AS total FROM silver_events e JOIN runs o ON e.user_id = o.run_id WHERE o.records_stored >= :stored AND e.value >= :least GROUP BY e.event_type, o.status"
    return lake.query(spark, root, text, {"stored": 2, "least": 20})


@query("snk_silver_overwrite", "SELECT ts::DATE AS date, count(*) AS n, sum(CASE WHEN ts::DATE = (SELECT min(ts::DATE) FROM events) THEN 1 ELSE 0 END)::BIGINT AS rewritten FROM events GROUP BY 1")
def snk_silver_overwrite(spark, sf_dir):
    """All dates once, then the first date again: counts stay."""
    e = a.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("date"), F.lit(0).alias("version"))
    root = lake.scratch(spark)
    lake.write_silver(e, root, "events")
    first = e.join(F.broadcast(e.agg(F.min("date").alias("date"))), "date", "left_semi").withColumn("version", F.lit(1))
    path = lake.write_silver(first.select(*e.columns), root, "events")
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"), F.sum("version").alias("rewritten"))


_LATEST = "SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, finished_at DESC NULLS LAST, seq DESC) AS rk FROM a_runs) WHERE rk = 1"


@query("log_upsert_latest", sql("SELECT run_id, source, started_at, status, seq FROM r", "a_runs", r=_LATEST))
def log_upsert_latest(spark, sf_dir):
    return lake.latest_runs(a.a_runs(spark, sf_dir)).select("run_id", "source", "started_at", "status", "seq")


@query("log_run_writes", sql("SELECT run_id, source, started_at, finished_at, status, errors, records_stored FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq % 3 DESC, started_at DESC, finished_at DESC NULLS LAST, source DESC, status DESC) AS rk FROM a_runs) WHERE rk = 1", "a_runs"))
def log_run_writes(spark, sf_dir):
    """Run records written by a commit for each rest of their numbers by three (none, and below zero, first); the last commit's
    record of a run counts."""
    runs, root = a.a_runs(spark, sf_dir), lake.scratch(spark)
    rest = F.col("seq") % 3
    for (i,) in runs.select(rest.alias("i")).distinct().orderBy(F.asc_nulls_first("i")).collect():  # six at most
        lake.record_runs(runs.filter(rest.eqNullSafe(i)), root)
    return lake.recorded_runs(spark, root)


@query("log_recent_runs", sql("SELECT run_id, source, started_at, status, records_stored, errors FROM r ORDER BY started_at DESC, run_id LIMIT 20", "a_runs", r=_LATEST))
def log_recent_runs(spark, sf_dir):
    """The 20 newest (the limit is the report)."""
    return lake.latest_runs(a.a_runs(spark, sf_dir)).orderBy(F.desc("started_at"), "run_id").limit(20).select("run_id", "source", "started_at", "status", "records_stored", "errors")


@query("log_last_run", sql("SELECT source, arg_max(run_id, (started_at, seq)) AS run_id, max(started_at) AS started_at FROM a_runs GROUP BY source", "a_runs"))
def log_last_run(spark, sf_dir):
    return a.a_runs(spark, sf_dir).groupBy("source").agg(F.max_by("run_id", F.struct("started_at", "seq")).alias("run_id"), F.max("started_at").alias("started_at"))


@query("log_run_status", sql("SELECT run_id, sum(errors)::BIGINT AS errors, sum(records_stored)::BIGINT AS records_stored, CASE WHEN bool_and(status = 'P') THEN 'skipped' WHEN sum(errors) = 0 THEN 'success' WHEN sum(records_stored) > 0 THEN 'partial' ELSE 'failed' END AS status FROM a_runs GROUP BY run_id", "a_runs"))
def log_run_status(spark, sf_dir):
    """Runs all of whose records are pending found nothing new: skipped."""
    return lake.run_status(a.a_runs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "P", "skipped").otherwise(F.col("status"))))


@query("log_bronze_manifest", " UNION ALL ".join(f"SELECT '{t}' AS source, TRUE AS has_files, count(*) AS n_rows FROM {t}" for t in ("events", "orders", "lineitem")))
def log_bronze_manifest(spark, sf_dir):
    """Files and rows by source; the number of files depends on who wrote them."""
    found = lake.manifest_by_source({t: a.table(spark, sf_dir, t) for t in ("events", "orders", "lineitem")})
    return found.select("source", ((F.col("n_files") > 0) & (F.col("n_bytes") > 0)).alias("has_files"), "n_rows")


_ZONED = "events"


def _zoned(spark, sf_dir):
    """events in files by time: the folder and its zone map."""
    root = lake.scratch(spark)
    path = f"{root}/{_ZONED}"
    a.table(spark, sf_dir, _ZONED).repartitionByRange(16, "ts", "event_id").sortWithinPartitions("ts").write.parquet(path)
    return path, footers.refresh(spark, path, f"{root}/zones")


@query("log_footer_manifest", f"SELECT '{_ZONED}' AS source, TRUE AS has_files, count(*)::BIGINT AS n_rows FROM {_ZONED}")
def log_footer_manifest(spark, sf_dir):
    """Files and rows of a table from its footers, without a look at its rows."""
    files = footers.by_file(_zoned(spark, sf_dir)[1]).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"), F.sum("n_rows").alias("n_rows"))
    return files.select(F.lit(_ZONED).alias("source"), ((F.col("n") > 1) & (F.col("bytes") > 0)).alias("has_files"), "n_rows")


def _sql_zone(column: str, value: str = "NULL::BIGINT", double: str = "NULL::DOUBLE", text: str = "NULL::VARCHAR") -> str:
    bounds = ", ".join(f"{f}({x}) AS {n}{kind}" for kind, x in (("", value), ("_double", double), ("_text", text)) for f, n in (("min", "low"), ("max", "high")))
    return f"SELECT '{column}' AS name, (count(*) - count({column}))::BIGINT AS nulls, {bounds} FROM {_ZONED}"


@query("log_zone_map", " UNION ALL ".join([_sql_zone("event_id", "event_id"), _sql_zone("ts", "epoch_us(ts)"), _sql_zone("user_id", "user_id"), _sql_zone("event_type", text="event_type"), _sql_zone("value", double="value"), _sql_zone("props", text="props")]))
def log_zone_map(spark, sf_dir):
    """Bounds and nulls of each column over all files of a table, from their footers."""
    kinds = [("", "low", "high"), ("_double", "low", "high"), ("_text", "low", "high")]
    bounds = [f(f"{n}{kind}").alias(f"{n}{kind}") for kind, low, high in kinds for f, n in ((F.min, low), (F.max, high))]
    return footers.by_column(_zoned(spark, sf_dir)[1]).groupBy("name").agg(F.sum("nulls").alias("nulls"), *bounds)


@query("flt_lookback_pruned", f"SELECT event_id, event_type, ts, TRUE AS files_skipped FROM {_ZONED} WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00'")
def flt_lookback_pruned(spark, sf_dir):
    """The rows of seven days, from the files whose footers say that they can hold some."""
    path, zones = _zoned(spark, sf_dir)
    got = footers.read_between(spark, path, zones, "ts", datetime.datetime(2024, 1, 23, 12), datetime.datetime(2024, 1, 30, 12))
    return got.select("event_id", "event_type", "ts", F.lit(len(got.inputFiles()) < zones.count()).alias("files_skipped"))


_CHECKS = {"value_known": "value IS NOT NULL", "value_over_ten": "value > 10", "known_type": "event_type IN ('view', 'click', 'error', 'purchase', 'signup')"}
_DQ_SQL = "SELECT * FROM (SELECT 'value_known' AS check_name, count_if(value IS NULL)::BIGINT AS failed, count(*) AS checked, count_if(value IS NULL) = 0 AS passed FROM events UNION ALL SELECT 'value_over_ten', count_if(coalesce(value <= 10, TRUE))::BIGINT, count(*), count_if(coalesce(value <= 10, TRUE)) = 0 FROM events UNION ALL SELECT 'known_type', count_if(event_type NOT IN ('view', 'click', 'error', 'purchase', 'signup'))::BIGINT, count(*), count_if(event_type NOT IN ('view', 'click', 'error', 'purchase', 'signup')) = 0 FROM events)"


@query("dq_checks", _DQ_SQL)
def dq_checks(spark, sf_dir):
    return lake.quality_checks(a.table(spark, sf_dir, "events"), _CHECKS)


@query("dq_write_checks", f"SELECT check_name, failed, checked, passed, checked AS written FROM ({_DQ_SQL})")
def dq_write_checks(spark, sf_dir):
    """Checks that are counted while the rows are written, by two writes; the log's rows and what was written."""
    root, e = lake.scratch(spark), a.table(spark, sf_dir, "events")
    for half in (0, 1):
        lake.write_checked(e.filter(F.col("event_id") % 2 == half), f"{root}/events", _CHECKS, root, "events", batch=half)
    log = lake.quality_log(spark, root).groupBy("check_name").agg(F.sum("failed").alias("failed"), F.sum("checked").alias("checked"), F.bool_and("passed").alias("passed"))
    return log.crossJoin(F.broadcast(spark.read.parquet(f"{root}/events").agg(F.count("*").alias("written"))))  # one row


@query("set_union_schema_drift", "SELECT event_id, user_id, value, NULL::VARCHAR AS props FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, NULL, props FROM events WHERE event_id % 2 <> 0")
def set_union_schema_drift(spark, sf_dir):
    e = a.table(spark, sf_dir, "events")
    return feeds.union_drifting(e.filter("event_id % 2 = 0").select("event_id", "user_id", "value"), e.filter("event_id % 2 <> 0").select("event_id", "user_id", "props"))
