"""Snapshots, silver partitions, gold, and the run, manifest and quality logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.sources import commits
from quaystone.sources.json_split import read_records


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/lake-{uuid.uuid4().hex[:12]}"


def write_snapshot_json(df: DataFrame, root: str, source: str, ingest_date: str) -> str:
    """Append a snapshot as JSON lines, which split; partitioned by source and date. A snapshot without rows leaves no file."""
    path = f"{root}/bronze"
    if not df.isEmpty():
        df.withColumns({"source": F.lit(source), "ingest_date": F.lit(ingest_date)}).write.mode("append").partitionBy("source", "ingest_date").json(path)
    return path


def write_envelopes(df: DataFrame, root: str, source: str, per_file: int = 500, indented: bool = False) -> str:
    """Append a snapshot as envelopes: one JSON object with its records in an array, of about per_file records each. indented:
    each over several lines, in a file of its own. A snapshot without rows leaves no file."""
    path = f"{root}/bronze_envelopes/{source}"
    n = df.count()
    if not n:
        return path
    chunk = F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(max(1, n // per_file)))
    packed = df.select(chunk.alias("chunk"), F.struct(*df.columns).alias("r")).groupBy("chunk").agg(F.collect_list("r").alias("records"))
    body = F.struct(F.lit("2001-01-30T00:00:00Z").alias("written_at"), F.lit(source).alias("source"), F.concat(F.lit("run-"), "chunk").alias("run_id"), F.size("records").alias("count"), "records")
    out = packed.select("chunk", F.to_json(body, {"pretty": "true"} if indented else {}).alias("value"))
    # maxRecordsPerFile puts each envelope into a file of its own, as one that spans lines can't share its file.
    (out.select("value").write.option("maxRecordsPerFile", 1) if indented else out.select("value").write).mode("append").text(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Spark's file systems is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_envelopes(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of envelopes, of bare arrays and of bare objects, over any number of lines; files of any size are read by many tasks.
    A file that isn't whole goes, and of JSON lines the bad lines; a missing folder has no records. record: schema of a record."""
    return read_records(spark, path, record) if exists(spark, path) else spark.createDataFrame([], record)


def write_snapshot_parquet(df: DataFrame, root: str, source: str) -> str:
    """Append a snapshot. One without rows leaves no file."""
    path = f"{root}/bronze_parquet/{source}"
    if not df.isEmpty():
        df.write.mode("append").parquet(path)
    return path


def write_silver(df: DataFrame, root: str, source: str, by: str = "date") -> str:
    """Replace the partitions that df has, and no others; a second write of the same rows changes nothing. Rows without the
    column `by` belong to today."""
    path = f"{root}/silver/{source}"
    dated = df if by in df.columns else df.withColumn(by, F.current_date())
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def write_gold(df: DataFrame, root: str, name: str = "port_features") -> str:
    """Replace a gold table, in the order of port and week."""
    path = f"{root}/gold/{name}"
    df.repartitionByRange("port_id", "week_ending").sortWithinPartitions("port_id", "week_ending").write.mode("overwrite").parquet(path)
    return path


def read_gold(spark: SparkSession, root: str, name: str = "port_features") -> DataFrame:
    """The gold table as it was written; a FileNotFoundError where there is none."""
    path = f"{root}/gold/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no gold table at {path}")
    return spark.read.parquet(path)


def availability(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source: source, n."""
    out = None
    for name, df in sources.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def stop_if_empty(counts: DataFrame) -> DataFrame:
    """counts as they are; a ValueError if no source has a row, as nothing can be built then."""
    if not counts.agg(F.sum("n")).first()[0]:
        raise ValueError("no source has any rows")
    return counts


def latest_runs(runs: DataFrame) -> DataFrame:
    """The record that counts of each run: the last by start, end and sequence."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("started_at"), F.desc_nulls_last("finished_at"), F.desc("seq")))
    return runs.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


RUNS = "run_id long, source string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, errors int, records_stored int"


def record_runs(runs: DataFrame, root: str) -> int:
    """Add records of runs to the log by one commit; a later record of a run replaces the earlier ones when the log is read.
    runs: run_id, source, started_at, finished_at, status, errors, records_stored."""
    names = [x.split(" ") for x in RUNS.split(", ")]
    return commits.append_rows(runs.select(*[F.col(n).cast(k).alias(n) for n, k in names]), f"{root}/runs")


def recorded_runs(spark: SparkSession, root: str) -> DataFrame:
    """The last record of each run: the one of the last commit; in it, the one that started and ended last. Of records that are equal
    but in their counts, the one with the most errors, then the most rows, so that files and tasks don't decide."""
    rows = commits.read_rows(spark, f"{root}/runs", RUNS)
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("commit"), F.desc("started_at"), F.desc_nulls_last("finished_at"), F.desc("source"), F.desc("status"), F.desc("errors"), F.desc("records_stored")))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "commit")


def run_status(runs: DataFrame) -> DataFrame:
    """Per run: skipped if all its records say so, success without errors, partial with some rows, else failed. Records without a
    status say nothing."""
    skipped = F.coalesce(F.bool_and(F.col("status") == "skipped"), F.lit(False)) if "status" in runs.columns else F.max(F.lit(False))
    sums = runs.groupBy("run_id").agg(F.sum("errors").alias("errors"), F.sum("records_stored").alias("records_stored"), skipped.alias("skipped"))
    status = F.when(F.col("skipped"), "skipped").when(F.col("errors") == 0, "success").when(F.col("records_stored") > 0, "partial").otherwise("failed")
    return sums.select("run_id", "errors", "records_stored", status.alias("status"))


LAYERS = {"gold": "gold", "silver": "silver", "bronze": "bronze_parquet"}


def tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Folders of the lake's tables by name: gold_x, silver_x, bronze_x."""
    out = {}
    for layer, folder in LAYERS.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
            out |= {f"{layer}_{n}": f"{root}/{folder}/{n}" for n in sorted(names)}
    return out


def query(spark: SparkSession, root: str, text: str, params: dict | list | None = None) -> DataFrame:
    """SQL over all tables of the lake, as gold_x, silver_x and bronze_x, and `runs`, with bound parameters (:name or ?). The names
    hold in a session of their own."""
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(key, None)
        if value is not None:
            session.conf.set(key, value)
    for name, path in tables(spark, root).items():
        session.read.parquet(path).createOrReplaceTempView(name)
    if exists(spark, f"{root}/runs/log"):
        recorded_runs(session, root).createOrReplaceTempView("runs")
    return session.sql(text, args=params)


def manifest(df: DataFrame) -> DataFrame:
    """Files of a table read from files, with size and rows."""
    files = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    return files.groupBy("file_path", "file_size").agg(F.count("*").alias("n_rows"))


def manifest_by_source(sources: dict[str, DataFrame]) -> DataFrame:
    """Files, bytes and rows of each source: source, n_files, n_bytes, n_rows."""
    out = None
    for name, df in sources.items():
        one = manifest(df).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        one = one.select(F.lit(name).alias("source"), "n_files", "n_bytes", "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def quality_checks(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """checks: name to condition that every row should meet. One pass; one row a check, with the rows that fail it."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, test in checks.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in checks)
    return one.select(F.expr(f"stack({len(checks)}, {pairs}) AS (check_name, failed)"), F.col("__n").alias("checked")).withColumn("passed", F.col("failed") == 0)


QUALITY = "commit long, table string, batch long, check_name string, failed long, checked long, passed boolean"


def write_checked(df: DataFrame, path: str, checks: dict[str, str], root: str, table: str, batch: int | None = None, mode: str = "append") -> int | None:
    """Write df to path and log what quality_checks() would find, counted while the rows are written: one pass over df. The log below
    root gets one commit a write, after the rows are there; a batch that is in the log already isn't logged again."""
    seen = Observation()
    failing = [F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(f"f{i}") for i, test in enumerate(checks.values())]
    df.observe(seen, F.count(F.lit(1)).alias("n"), *failing).write.mode(mode).parquet(path)
    found = seen.get
    entry = {"table": table, "batch": batch, "checked": found["n"], "failed": {name: found[f"f{i}"] for i, name in enumerate(checks)}}
    known = lambda log: batch is not None and any((e["table"], e["batch"]) == (table, batch) for e in log)
    return commits.commit(df.sparkSession, f"{root}/quality", entry, unless=known)


def quality_log(spark: SparkSession, root: str) -> DataFrame:
    """One row a check and write: commit, table, batch, check_name, failed, checked, passed."""
    rows = [(e["number"], e["table"], e["batch"], name, n, e["checked"], n == 0) for e in commits.entries(spark, f"{root}/quality") for name, n in e["failed"].items()]
    return spark.createDataFrame(rows, QUALITY)


def run_checked(stream: DataFrame, path: str, checks: dict[str, str], root: str, table: str, checkpoint: str) -> None:
    """Write what a stream has with write_checked(), a folder a batch, then stop. A batch that runs again replaces its folder."""

    def put(batch: DataFrame, number: int) -> None:
        write_checked(batch, f"{path}/batch={number}", checks, root, table, number, "overwrite")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
