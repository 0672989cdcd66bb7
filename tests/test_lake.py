"""Sources, sinks, logs and the entry points."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quaystone import plans
from quaystone.sources import feeds, lake

SF = "/root/testdata/sf0.001"


def test_envelopes_arrays_and_garbage(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"written_at":"t","source":"nws","count":2,"records":[{"id":"1"},{"id":"2"}]}\n[{"id":"3"}]\n{"id":"4"}\nnot json\n{"records":[]}\n')
    assert sorted(r.id for r in lake.read_envelopes(spark, str(tmp_path), "id:string").collect()) == ["1", "2", "3", "4"]


def test_indented_files_and_bad_ones(spark, tmp_path):
    import json

    records = [{"id": "1"}, {"id": "2"}]
    (tmp_path / "a.json").write_text(json.dumps({"written_at": "t", "source": "nws", "count": 2, "records": records}, indent=2) + "\n")
    (tmp_path / "b.json").write_text("\n" + json.dumps([{"id": "3"}, {"id": "4", "more": {"x": [1, 2]}}], indent=4))
    (tmp_path / "c.json").write_text(json.dumps({"id": "5"}, indent=1))
    (tmp_path / "d.json").write_text(json.dumps({"records": []}, indent=2))
    (tmp_path / "e.json").write_text('{\n  "records": [\n    {"id": "6"')
    (tmp_path / "f.json").write_text("")
    (tmp_path / "g.json").write_text('{"id":"7"}\r\n{"id":"8"}\r\n')
    assert sorted(r.id for r in lake.read_envelopes(spark, str(tmp_path), "id:string").collect()) == ["1", "2", "3", "4", "5", "7", "8"]
    assert lake.read_envelopes(spark, str(tmp_path / "none"), "id string").count() == 0


def test_empty_snapshots_leave_no_file(spark, tmp_path):
    none = spark.createDataFrame([], "id string")
    paths = [lake.write_snapshot_json(none, str(tmp_path), "nws", "2024-01-01"), lake.write_envelopes(none, str(tmp_path), "nws"), lake.write_snapshot_parquet(none, str(tmp_path), "nws")]
    assert not any(lake.exists(spark, p) for p in paths)


def test_gold_reads_back_in_order(spark, tmp_path):
    rows = [(p, f"2024-01-{d:02d}", i) for i, (p, d) in enumerate((p, d) for d in (21, 7, 14) for p in ("miami", "baltimore", "oakland"))]
    path = lake.write_gold(spark.createDataFrame(rows, "port_id string, week_ending string, v int"), str(tmp_path))
    got = [(r.port_id, r.week_ending, r.v) for r in lake.read_gold(spark, str(tmp_path)).collect()]
    assert got == sorted(rows) and path.startswith(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        lake.read_gold(spark, str(tmp_path), "other")


def test_availability_stops_without_rows(spark):
    none, some = spark.createDataFrame([], "a int"), spark.createDataFrame([(1,), (2,)], "a int")
    assert {r.source: r.n for r in lake.stop_if_empty(lake.availability({"x": none, "y": some})).collect()} == {"x": 0, "y": 2}
    with pytest.raises(ValueError):
        lake.stop_if_empty(lake.availability({"x": none}))


def test_manifest(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    files = lake.manifest(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert len(files) == 2 and sum(r.n_rows for r in files) == 10 and all(r.file_size > 0 for r in files)
    one = lake.manifest_by_source({"t": spark.read.parquet(str(tmp_path / "t"))}).first()
    assert (one.source, one.n_files, one.n_rows) == ("t", 2, 10) and one.n_bytes == sum(r.file_size for r in files)


def test_silver_overwrites_only_its_dates(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    lake.write_silver(df, str(tmp_path), "x")
    path = lake.write_silver(df.filter("v = 2").withColumn("v", F.lit(5)), str(tmp_path), "x")
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 5]


def test_run_log(spark):
    runs = spark.createDataFrame([(1, "2024-01-01", None, 1, 0, 5), (1, "2024-01-01", "2024-01-02", 2, 1, 0), (2, "2024-01-03", None, 3, 1, 0)], "run_id long, started_at string, finished_at string, seq long, errors int, records_stored int")
    assert {r.run_id: r.seq for r in lake.latest_runs(runs).collect()} == {1: 2, 2: 3}
    assert {r.run_id: r.status for r in lake.run_status(runs).collect()} == {1: "partial", 2: "failed"}


def test_month_forms(spark):
    df = spark.createDataFrame([("9/1/2022",), ("2022-09-01",), ("2022-09-01T00:00:00.000",), ("soon",)], "m string")
    assert [str(r[0]) for r in df.select(feeds.month_date(F.col("m"))).collect()] == ["2022-09-01"] * 3 + ["None"]


def test_pages_hold_a_number_of_rows(spark, monkeypatch):
    from quaystone.plans import lake as plans_lake

    pages = []
    rows = spark.range(30_000).selectExpr("id AS event_id", "cast(id AS string) AS alert_id", "cast(id AS string) AS usgs_id", "'Fog' AS event_type", "'Minor' AS severity", "timestamp_ntz'2024-01-01 00:00:00' AS effective", "timestamp_ntz'2024-01-01 00:00:00' AS occurred_at", "1.0D AS magnitude", "1.0D AS depth_km", "1.0D AS lat", "1.0D AS lon", "true AS tsunami_flag")
    alerts, quakes = feeds.parse_alerts, feeds.parse_quakes
    monkeypatch.setattr(plans_lake.a, "a_nws", lambda spark, sf_dir: rows)
    monkeypatch.setattr(plans_lake.a, "a_usgs_raw", lambda spark, sf_dir: rows)
    monkeypatch.setattr(feeds, "parse_alerts", lambda raw: pages.append(raw) or alerts(raw))
    monkeypatch.setattr(feeds, "parse_quakes", lambda raw: pages.append(raw) or quakes(raw))
    assert plans_lake.src_nws_geojson(spark, "").count() == 30_000 and plans_lake.src_usgs_geojson(spark, "").count() == 25_000
    for raw in pages:
        sizes = [r[0] for r in raw.select(F.expr("json_array_length(get_json_object(value, '$.features'))")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 700


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    """A value as it compares between the two engines: numbers to nine digits, dates at midnight as dates."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE_SQL)))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    r = duck.execute(plans.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect()) == sorted(tuple(plain(v) for v in row) for row in r.fetchall())


def test_entry_points(spark):
    found = __spark_entry__.queries()
    assert set(plans.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_zips_of_bounded_size(spark, tmp_path):
    """However many lines a task has, a zip holds so many at most, and all lines are in one."""
    import zipfile

    from quaystone.plans.lake import _zipped
    from quaystone.sources import feeds

    lines = spark.range(1003).selectExpr("CAST(id AS string) AS value").coalesce(1)
    names = [r["name"] for r in lines.mapInArrow(_zipped(f"file://{tmp_path}", 100), "name string").collect()]
    found = []
    for name in names:
        with zipfile.ZipFile(tmp_path / name) as z:
            own = [x for m in z.namelist() for x in z.read(m).decode().split()]
            assert len(z.namelist()) == 2 and 0 < len(own) <= 100
            found += own
    assert len(names) == 11 and sorted(map(int, found)) == list(range(1003))
    assert feeds.read_news_zip(spark, []).count() == 0


def test_zipped_news(spark, tmp_path):
    """Members of several zip files; one that is cut off, one with a bad checksum and one that is no zip are left out."""
    import zipfile

    line = lambda i: "\t".join([str(i), "20240101", *[""] * 56])
    for name, members in {"a": [range(3), range(3, 5)], "b": [range(5, 9)], "cut": [range(100, 400)], "bad": [range(500, 600)], "empty": [[]]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for k, ids in enumerate(members):
                z.writestr(f"{k}.csv", "\r\n".join([*map(line, ids), "too\tshort", "x" + line("")]) + "\n")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "cut.zip").read_bytes()[:-60])
    raw = bytearray((tmp_path / "bad.zip").read_bytes())
    raw[60] ^= 255
    (tmp_path / "bad.zip").write_bytes(raw)
    (tmp_path / "no.zip").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_text("x")
    got = feeds.read_news_zip(spark, str(tmp_path))
    assert sorted(r.GlobalEventID for r in got.filter("GlobalEventID IS NOT NULL").collect()) == list(range(9)) and got.columns == list(feeds.NEWS_KEPT)


def test_checks_during_writes(spark, tmp_path):
    """Counted in the pass that writes: a source that is read once more would count its rows twice. A row a check and batch; a batch
    that runs again isn't logged twice."""
    root, reads = str(tmp_path), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id"))).mapInArrow(counted, "id long, v long")
    checks = {"known": "v IS NOT NULL", "small": "v < 90", "all": "id >= 0"}
    for _ in range(2):
        lake.write_checked(rows, f"{root}/t", checks, root, "t", batch=1, mode="overwrite")
    assert reads.value == 200 and spark.read.parquet(f"{root}/t").count() == 100
    got = sorted(tuple(r) for r in lake.quality_log(spark, root).collect())
    assert got == [(0, "t", 1, "all", 0, 100, True), (0, "t", 1, "known", 10, 100, False), (0, "t", 1, "small", 19, 100, False)]
    again = sorted(tuple(r)[:2] for r in lake.quality_checks(spark.read.parquet(f"{root}/t"), checks).collect())
    assert again == [("all", 0), ("known", 10), ("small", 19)]


def test_checks_of_a_stream(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        lake.run_checked(stream, f"{root}/out", {"even": "id % 2 = 0", "known": "id IS NOT NULL"}, root, "ids", f"{root}/checkpoint")
    got = lake.quality_log(spark, root).collect()
    assert sorted((r.batch, r.check_name, r.failed, r.checked, r.passed) for r in got) == sorted((b, c, f, 10, f == 0) for b in range(3) for c, f in (("even", 5), ("known", 0)))
    assert spark.read.parquet(f"{root}/out").count() == 30


def _orders(spark, path, rows):
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{path}/orders.parquet")


def test_run_records_of_any_number(spark, tmp_path):
    """Numbers below zero and none have a commit too; records that differ in their counts only are settled by these."""
    import datetime as dt

    import duckdb

    from quaystone import plans
    from quaystone.sources import lake

    day = dt.datetime(2024, 1, 1)
    rows = [(k, c, "F", 1.0, day + dt.timedelta(days=d), "1-URGENT") for k, c, d in [(-4, 1, 0), (-2, 1, 1), (-3, 2, 0), (-1, 3, 0), (None, 4, 0), (None, 5, 1), (-6, 5, 0), (5, 6, 0), (4, 6, 3), (7, 7, 0)]]
    _orders(spark, tmp_path, rows)
    got = plans.QUERIES["log_run_writes"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLE_SQL['log_run_writes']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 7
    same = "SELECT 1L AS run_id, 'a' AS source, TIMESTAMP_NTZ '2024-01-01' AS started_at, TIMESTAMP_NTZ '2024-01-02' AS finished_at, 'F' AS status, 0 AS errors, {} AS records_stored"
    for i, order in enumerate(([1, 4, 2], [2, 1, 4], [4, 2, 1])):
        lake.record_runs(spark.sql(" UNION ALL ".join(same.format(x) for x in order)).coalesce(1), f"{tmp_path}/{i}")
        assert [r.records_stored for r in lake.recorded_runs(spark, f"{tmp_path}/{i}").collect()] == [4]


def test_sums_over_the_lake_are_exact(spark, tmp_path):
    """A million cents in one task: doubles added one by one end at another sixth digit. Values that are no numbers stay so."""
    import datetime as dt

    from quaystone import plans

    day = dt.datetime(2024, 1, 1)
    _orders(spark, tmp_path, [(4, 1, "F", 1.0, day, "1-URGENT"), (9, 2, "O", 1.0, day, "1-URGENT")])
    events = spark.range(1_000_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 01:00:00' AS ts", "1L AS user_id", "'click' AS event_type", "20.1D + id % 7 / 10D AS value", "'' AS props")
    odd = spark.sql("SELECT -1L AS event_id, TIMESTAMP_NTZ '2024-01-01 01:00:00' AS ts, 2L AS user_id, 'view' AS event_type, double('Infinity') AS value, '' AS props UNION ALL SELECT -2L, TIMESTAMP_NTZ '2024-01-01 01:00:00', 2L, 'error', 1e300D, ''")
    events.union(odd).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: (r.n, r.total) for r in plans.QUERIES["sql_lake_query"](spark, str(tmp_path)).collect()}
    cents = sum(201 + i % 7 for i in range(1_000_000))
    assert got == {"click": (1_000_000, cents / 10), "view": (1, float("inf")), "error": (1, 1e300)}
