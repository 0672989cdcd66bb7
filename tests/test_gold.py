"""The gold table from any feed, kept up to date in pieces, against the table built at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.operators import weekly
from quaystone.plans.registry import rounded
from quaystone.registry import GOLD_COLUMNS, ports
from quaystone.streaming import gold as g

DIR = "/root/testdata/sf0.001"
VIEWS = {"throughput": a.a_bts_dup, "weather": a.a_nws, "news": a.a_gdelt, "quakes": a.a_usgs, "fires": a.a_firms}


def rows(df):
    return sorted((tuple(r) for r in rounded(df.select(*GOLD_COLUMNS), eq_energy_proxy=0).collect()), key=str)


def at_once(spark, feeds):
    """feeds: rows by feed."""
    made = {f: v.weekly(g._shaped(feeds.get(f, spark.createDataFrame([], v.schema)), f)) for f, v in g.FEEDS.items()}
    return weekly.gold(ports(spark), *made.values(), as_of=a.AS_OF)


def test_gold_without_throughput(spark):
    """The last 104 weeks up to the given day, with what the other feeds have."""
    weather = a.a_nws(spark, DIR)
    found = at_once(spark, {"weather": weather})
    assert found.count() == 1040 and found.columns == GOLD_COLUMNS
    got = found.agg(F.min("week_ending"), F.max("week_ending"), F.sum("alert_count"), F.count("median_berthing_time_hrs"), F.min("data_completeness_score"), F.max("data_completeness_score")).first()
    first, last = dt.date(2001, 2, 4) - dt.timedelta(weeks=103), dt.date(2001, 2, 4)
    inside = weekly.weather_weekly(weather).filter(F.col("week_ending").between(first, last)).agg(F.sum("alert_count")).first()[0]
    assert inside > 0 and tuple(got) == (first, last, inside, 0, 0.2, 0.2)
    assert at_once(spark, {}).agg(F.max("data_completeness_score")).first()[0] == 0


@pytest.fixture(scope="module")
def feeds(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("feeds"))
    for f, v in VIEWS.items():
        v(spark, DIR).write.parquet(f"{root}/{f}")
    return {f: spark.read.parquet(f"{root}/{f}") for f in VIEWS}


def test_shuffled_batches_and_replays_give_the_whole_table(spark, tmp_path, feeds):
    """Batches of all feeds in any order, some twice; and between them the table is that of the rows so far."""
    root, rng, so_far = str(tmp_path / "gold"), random.Random(5), {}
    parts = {"throughput": 3, "weather": 2, "news": 1, "quakes": 1, "fires": 1}
    todo = [(f, i) for f, n in parts.items() for i in range(n)]
    rng.shuffle(todo)
    for step, (feed, i) in enumerate(todo):
        key = F.xxhash64(*[c for c in feeds[feed].columns]) if feed != "throughput" else F.xxhash64("port_id", F.date_trunc("quarter", "week_ending"))
        batch = feeds[feed].filter(F.pmod(key, F.lit(parts[feed])) == i)
        assert g.refresh(feed, batch, i, root, ports(spark), a.AS_OF)
        if rng.random() < 0.3:
            assert not g.refresh(feed, batch, i, root, ports(spark), a.AS_OF)
        so_far[feed] = batch if feed not in so_far else so_far[feed].union(batch)
        if step == 4:
            assert rows(g.read_gold(spark, root)) == rows(at_once(spark, so_far)), step
    assert rows(g.read_gold(spark, root)) == rows(at_once(spark, feeds))
    assert not g.compact(spark, root) and g.compact(spark, root, 2) and not g.compact(spark, root, 2)
    assert rows(g.read_gold(spark, root)) == rows(at_once(spark, feeds))
    # After compaction a late row and an empty batch.
    late = feeds["throughput"].orderBy("week_ending", "port_id").limit(1).withColumn("median_berthing_time_hrs", F.lit(99.0)).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 9 DAY"))
    assert g.refresh("throughput", late, 77, root, ports(spark), a.AS_OF) and g.refresh("news", feeds["news"].limit(0), 78, root, ports(spark), a.AS_OF)
    assert rows(g.read_gold(spark, root)) == rows(at_once(spark, feeds | {"throughput": feeds["throughput"].union(late)}))


def test_only_rows_in_reach_change(spark):
    weeks = [dt.date(2000, 1, 2) + dt.timedelta(weeks=i) for i in range(300) if i % 7]
    keys = spark.createDataFrame([(p, w) for p in "ab" for w in weeks], "port_id string, week_ending date")
    touched = keys.filter((F.col("port_id") == "a") & F.col("week_ending").isin(weeks[10], weeks[150]))
    got = {(r.port_id, r.week_ending): (r.changed, r.needed) for r in g._changed_by_throughput(keys, touched).collect()}
    for i, w in enumerate(weeks):
        changed = 10 <= i <= 62 or 150 <= i <= 202
        assert got["a", w] == (changed, changed or i < 10 or 98 <= i < 150) and got["b", w] == (False, False)


def test_few_weeks_are_read(spark, tmp_path, feeds):
    """A batch of one week's events reads that week of the other feeds only."""
    root = str(tmp_path / "gold")
    for feed in ("throughput", "weather", "fires"):
        g.refresh(feed, feeds[feed], 0, root, ports(spark), a.AS_OF)
    state = g._State(g.commits.entries(spark, f"{root}/log"))
    week = feeds["throughput"].agg(F.max("week_ending")).first()[0]
    plan = state.read(spark, root, "weather", [week])._jdf.queryExecution().executedPlan().toString()
    assert f"(year#" in plan and "PartitionFilters" in plan and "In(week_ending" in plan or "EqualTo(week_ending" in plan
    assert state.read(spark, root, "weather", [week]).count() == feeds["weather"].filter(g.FEEDS["weather"].week() == F.lit(week)).count()
