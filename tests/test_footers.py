"""Zone maps from footers, and reads that skip files by them."""

import datetime as dt
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quaystone.sources import footers


def written(spark, tmp_path, n=1000, files=10):
    df = spark.range(n).select(
        "id", (F.col("id") * 2).cast("int").alias("twice"), F.expr("timestampadd(MINUTE, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("at"),
        F.expr("timestampadd(MINUTE, id, TIMESTAMP'2024-01-01 00:00:00')").alias("zoned"), F.expr("date_add(DATE'2024-01-01', int(id))").alias("day"),
        F.format_string("k%05d", "id").alias("name"), (F.col("id") / 4).alias("x"), (F.col("id") / 8).cast("decimal(12,3)").alias("d"), F.when(F.col("id") % 3 == 0, None).otherwise(1).alias("gap"),
    )
    path = f"{tmp_path}/table"
    df.repartitionByRange(files, "id").write.parquet(path)
    return path, df


def files_of(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_zones_are_those_of_the_rows(spark, tmp_path):
    path, df = written(spark, tmp_path)
    zones = footers.refresh(spark, path, f"{tmp_path}/zones")
    files = footers.by_file(zones).collect()
    assert len(files) == 10 and sum(r.n_rows for r in files) == 1000 and all(r.file_size > 0 for r in files)
    by = {(r.file_path.rsplit("/", 1)[1], r.name): r for r in footers.by_column(zones).collect()}
    per = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_if(F.col("gap").isNull()).alias("gaps")).collect()
    for r in per:
        assert (by[r.f, "id"].low, by[r.f, "id"].high) == (r.a, r.b) and by[r.f, "gap"].nulls == r.gaps
        assert (by[r.f, "name"].low_text, by[r.f, "name"].high_text) == (f"k{r.a:05}", f"k{r.b:05}")
        assert (by[r.f, "x"].low_double, by[r.f, "x"].high_double) == (r.a / 4, r.b / 4)
        assert by[r.f, "d"].low_double <= r.a / 8 + 1e-3 and by[r.f, "d"].high_double >= r.b / 8 - 1e-3


@pytest.mark.parametrize("column, low, high", [
    ("id", 250, 260), ("id", None, 99), ("id", 990, None), ("twice", 10.5, 11.5), ("at", dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6)), ("day", dt.date(2025, 1, 1), dt.date(2025, 1, 9)),
    ("name", "k00500", "k00510"), ("x", None, 3.0), ("d", 100, 101), ("id", 5000, None), ("zoned", dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6)),
])
def test_reads_skip_files_and_lose_nothing(spark, tmp_path, column, low, high):
    # By default Spark writes zoned timestamps in a form that has no bounds.
    default = spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        path, df = written(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", default)
    zones = footers.refresh(spark, path, f"{tmp_path}/zones")
    got = footers.read_between(spark, path, zones, column, low, high)
    want = spark.read.parquet(path)
    want = want if low is None else want.filter(F.col(column) >= F.lit(low))
    want = want if high is None else want.filter(F.col(column) <= F.lit(high))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert len(got.inputFiles()) <= 2 < 10


def test_columns_without_bounds_are_read_whole(spark, tmp_path):
    path, _ = written(spark, tmp_path)
    got = footers.read_between(spark, path, footers.refresh(spark, path, f"{tmp_path}/zones"), "zoned", low=dt.datetime(2024, 1, 1, 10))
    assert got.count() == 400 and len(got.inputFiles()) == 10


def test_only_new_files_are_read_and_gone_ones_drop(spark, tmp_path):
    path, at = f"{tmp_path}/table", f"{tmp_path}/zones"
    spark.range(10).repartition(2).write.parquet(path)
    assert footers.refresh(spark, path, at).count() == 2
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(path)
    assert footers.refresh(spark, path, at).count() == 3
    assert spark.read.parquet(at).count() == 3
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(path)
    assert [r.n_rows for r in footers.refresh(spark, path, at).collect()] == [5]


def test_nulls_nan_partitions_empty_and_foreign_files(spark, tmp_path):
    path, at = f"{tmp_path}/table", f"{tmp_path}/zones"
    for i, xs in enumerate(([1.0, 2.0], [1.0, math.nan], [None, None])):
        folder = tmp_path / "table" / f"part={i}"
        folder.mkdir(parents=True)
        pq.write_table(pa.table({"x": pa.array(xs, pa.float64()), "n": pa.array([i, None], pa.int64())}), folder / "a b.parquet")
    zones = footers.refresh(spark, path, at)
    nan = footers.matching(zones, "x", "double", low=5.0).collect()
    assert any("part=1" in r.file_path for r in nan) and not any("part=2" in r.file_path for r in nan)
    assert [r.part for r in footers.read_between(spark, path, zones, "n", 2, 2).collect()] == [2]
    assert footers.matching(zones, "x", "double", high=9.0).count() == 2  # nulls match nothing
    assert footers.matching(zones, "absent", "bigint", low=9).count() == 3
    (tmp_path / "table" / "part=0" / "bad.parquet").write_bytes(b"nothing")
    bad = footers.refresh(spark, path, at)
    assert bad.filter("n_rows IS NULL").count() == 1 and footers.matching(bad, "n", "bigint", low=99).count() == 1
    (tmp_path / "none").mkdir()
    assert footers.refresh(spark, f"{tmp_path}/none", f"{tmp_path}/z2").count() == 0


def test_a_single_file_is_a_table_too(spark, tmp_path):
    pq.write_table(pa.table({"n": pa.array([1, 2, 3])}), tmp_path / "t.parquet")
    zones = footers.refresh(spark, f"{tmp_path}/t.parquet", f"{tmp_path}/zones")
    assert sorted(r.n for r in footers.read_between(spark, f"{tmp_path}/t.parquet", zones, "n", 2).collect()) == [2, 3]
    assert footers.read_between(spark, f"{tmp_path}/t.parquet", zones, "n", 9).collect() == []
