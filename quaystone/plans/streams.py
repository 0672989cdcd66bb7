"""Streaming queries: the driver's tables land as files and stream through to the end of what is there.

Each has the SQL of its batch form, as a stream over all files must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.adapters import sql
from quaystone.plans.features import GOLD_ROUNDED, W_WEATHER, gold_sql
from quaystone.plans.registry import query, rounded
from quaystone.registry import ports
from quaystone.sources.lake import scratch
from quaystone.streaming import gold, jobs, late

_ALERTS = "alert_id string, port_id string, event_type string, severity string, effective timestamp"


def _landed(spark, sf_dir, repeated: bool = False) -> tuple[str, str]:
    """Alerts as landed files; with repeats, every fifth one polled again. Returns the folder and the files' folder."""
    root = scratch(spark)
    rows = a.a_nws(spark, sf_dir).select("alert_id", "port_id", "event_type", "severity", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("effective")).cast("timestamp").alias("effective"), "event_id")
    if repeated:
        rows = rows.union(rows.filter("event_id % 5 = 0"))
    rows.drop("event_id").repartition(4).write.parquet(f"{root}/landed")
    return root, f"{root}/landed"


@query("str_ingest", sql("SELECT alert_id, port_id, severity FROM a_nws", "a_nws"))
def str_ingest(spark, sf_dir):
    """Each landed file once, also when the job starts again."""
    root, files = _landed(spark, sf_dir)
    for _ in range(2):
        jobs.run_available(jobs.stream(spark, files, _ALERTS, 2), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(_ALERTS).parquet(f"{root}/out").select("alert_id", "port_id", "severity")


@query("str_dedup", sql("SELECT alert_id, port_id, event_type FROM a_nws", "a_nws"))
def str_dedup(spark, sf_dir):
    root, files = _landed(spark, sf_dir, repeated=True)
    jobs.run_available(jobs.deduplicated(jobs.stream(spark, files, _ALERTS), "alert_id", "effective"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(_ALERTS).parquet(f"{root}/out").select("alert_id", "port_id", "event_type")


@query("str_weekly_agg", sql("SELECT * FROM w", "a_nws", w=W_WEATHER))
def str_weekly_agg(spark, sf_dir):
    """Update mode, so that weeks the watermark hasn't passed are there too."""
    root, files = _landed(spark, sf_dir)
    out = jobs.weekly_alerts(jobs.stream(spark, files, _ALERTS))
    jobs.run_keyed(out, f"{root}/out", f"{root}/checkpoint")
    return jobs.read_keyed(spark, f"{root}/out", out, ["port_id", "week_ending"])


@query("str_sliding_active", sql("SELECT port_id, (effective::DATE + d.i::INTEGER + 1)::DATE AS day, count(*) AS active FROM a_nws, (SELECT unnest(range(7)) AS i) d GROUP BY 1, 2", "a_nws"))
def str_sliding_active(spark, sf_dir):
    root, files = _landed(spark, sf_dir)
    out = jobs.sliding_active(jobs.stream(spark, files, _ALERTS))
    jobs.run_keyed(out, f"{root}/out", f"{root}/checkpoint")
    return jobs.read_keyed(spark, f"{root}/out", out, ["port_id", "day"])


@query("str_late_reconcile", sql("SELECT * FROM w", "a_nws", w=W_WEATHER))
def str_late_reconcile(spark, sf_dir):
    """The oldest tenth of the alerts arrives after all others, over 30 days late: the rows go aside and are then added to their weeks."""
    root, files = _landed(spark, sf_dir)
    rows = spark.read.schema(_ALERTS).parquet(files)
    first, last = rows.agg(F.min(F.unix_seconds("effective")), F.max(F.unix_seconds("effective"))).first()
    old = F.unix_seconds("effective") < F.lit(first + (last - first) // 10)
    rows.filter(~old).repartition(3).write.parquet(f"{root}/feed")
    late.run(jobs.stream(spark, f"{root}/feed", _ALERTS, 2), f"{root}/weeks", f"{root}/checkpoint")
    rows.filter(old).repartition(2).write.mode("append").parquet(f"{root}/feed")
    late.run(jobs.stream(spark, f"{root}/feed", _ALERTS, 2), f"{root}/weeks", f"{root}/checkpoint")
    if last - first > 50 * 86_400 and not late.late_rows(spark, f"{root}/weeks").count():
        raise RuntimeError("no row came late")
    late.reconcile(spark, f"{root}/weeks")
    late.compact(spark, f"{root}/weeks", least=2)
    return late.read(spark, f"{root}/weeks")


_FEEDS = {"throughput": (a.a_bts, 3), "weather": (a.a_nws, 2), "fires": (a.a_firms, 1), "quakes": (a.a_usgs, 1), "news": (a.a_gdelt, 2)}


@query("str_gold_refresh", gold_sql(GOLD_ROUNDED))
def str_gold_refresh(spark, sf_dir):
    """Five feeds land in files and stream in by batches of two files, the last throughput after all others; each batch changes the
    gold rows it can change."""
    root = scratch(spark)
    for feed, (view, files) in _FEEDS.items():
        rows = view(spark, sf_dir)
        rows.repartition(files).write.parquet(f"{root}/landed/{feed}")
    for feed in ("weather", "throughput", "fires", "quakes", "news"):
        schema = spark.read.parquet(f"{root}/landed/{feed}").schema
        gold.run_feed(feed, jobs.stream(spark, f"{root}/landed/{feed}", schema, 2), f"{root}/gold", f"{root}/checkpoint/{feed}", ports(spark), a.AS_OF)
    return rounded(gold.read_gold(spark, f"{root}/gold"), eq_energy_proxy=0)
