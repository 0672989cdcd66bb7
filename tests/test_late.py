"""Late rows: kept aside in the same commit, and added to their weeks once."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quaystone.operators.weekly import weather_weekly
from quaystone.sources import commits
from quaystone.streaming import jobs, late

SCHEMA = late.ALERTS.schema


def alerts(spark, days, tag):
    rows = [(f"{tag}{i}", "pa"[i % 2], ["Flood Advisory", "Tornado Warning"][i % 2], ["Extreme", "Minor", "Severe"][i % 3], dt.datetime(2024, 3, 1) + dt.timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, SCHEMA)


def test_rows_thirty_days_late(spark, tmp_path):
    root, files, checkpoint = (str(tmp_path / x) for x in ("weeks", "files", "checkpoint"))
    first, second = alerts(spark, [60, 61, 70, 80], "a"), alerts(spark, [50, 49.99, 66, 95, 66.01, 10], "b")
    first.coalesce(1).write.parquet(files)
    for _ in range(2):  # the second run finds nothing new
        late.run(jobs.stream(spark, files, SCHEMA), root, checkpoint)
    second.coalesce(1).write.mode("append").parquet(files)
    late.run(jobs.stream(spark, files, SCHEMA), root, checkpoint)
    # The newest row of the first batch is of day 80, and rows of up to 14 days before are in time.
    assert sorted(r.alert_id for r in late.late_rows(spark, root).collect()) == ["b0", "b1", "b5"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = first.union(second)
    assert rows(late.read(spark, root)) == rows(weather_weekly(whole.filter(~F.col("alert_id").isin("b0", "b1", "b5"))))
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda _: late.reconcile(spark, root), range(3)))
    assert sorted(done) == [0, 0, 1] and late.late_rows(spark, root).count() == 0
    assert rows(late.read(spark, root)) == rows(weather_weekly(whole))
    assert not late.compact(spark, root, least=50) and late.compact(spark, root, least=2) and not late.compact(spark, root, least=2)
    assert rows(late.read(spark, root)) == rows(weather_weekly(whole))


def test_a_batch_counts_once(spark, tmp_path):
    root, batch = str(tmp_path / "weeks"), alerts(spark, [1, 2, 3], "a")
    assert late.take_in(batch, 0, root, late.ALERTS, 86_400)
    with ThreadPoolExecutor(4) as pool:
        assert not any(pool.map(lambda _: late.take_in(batch, 0, root, late.ALERTS, 86_400), range(4)))
    assert late.take_in(batch.limit(0), 1, root, late.ALERTS, 86_400)
    assert late.read(spark, root).agg(F.sum("alert_count")).first()[0] == 3
    assert [e["rows_in"] for e in commits.entries(spark, f"{root}/log")] == [3, 0]
    assert late.read(spark, str(tmp_path / "none")).count() == 0 and late.reconcile(spark, str(tmp_path / "none")) == 0
