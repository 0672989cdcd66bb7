"""A manifest of Parquet files with zone maps, from their footers alone, and reads that open only files that can match.

Tasks read the footers, a range of files each; no data page is read. The map is a table of one row a file, kept up to date by the
files that are new. What a file doesn't say is unknown, and a file with an unknown bound is always read.

Cases: nulls never match a bound; a column of nulls only has no bounds, and its files match nothing; NaN is over all numbers, as
in Spark, but writers leave it out of their bounds, so lower bounds of doubles exclude no file; a file that is no Parquet file
has no rows and no zones here, and is read (and fails) as any other reader would; columns that a file lacks are unknown, and
so are zoned timestamps in Spark's default form (INT96; spark.sql.parquet.outputTimestampType has others); an empty folder gives
an empty map.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.sources.lake import exists

_BOUNDS = ("low", "high", "low_double", "high_double", "low_text", "high_text")
ZONE = "struct<name string, nulls long, low long, high long, low_double double, high_double double, low_text string, high_text string>"
SCHEMA = f"file_path string, file_size long, modified timestamp, n_rows long, zones array<{ZONE}>"
_EPOCH, _DAY = dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)


def _opened(path: str):
    """File system and name of a path as Spark lists it (not percent-encoded)."""
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@?&=+,~"))


def _bounds(low, high) -> dict:
    """Bounds by kind: whole numbers (also days and microseconds), doubles and texts. Other types have none."""
    if isinstance(low, bool) or type(low) is not type(high):
        return {}
    if isinstance(low, int):
        return {"low": low, "high": high} if -(1 << 63) <= low <= high < 1 << 63 else {}
    if isinstance(low, dt.datetime):
        plain = [x.astimezone(dt.UTC).replace(tzinfo=None) if x.tzinfo else x for x in (low, high)]
        return dict(zip(("low", "high"), [(x - _EPOCH) // dt.timedelta(microseconds=1) for x in plain], strict=True))
    if isinstance(low, dt.date):
        return {"low": (low - _DAY).days, "high": (high - _DAY).days}
    if isinstance(low, Decimal):
        return {"low_double": math.nextafter(float(low), -math.inf), "high_double": math.nextafter(float(high), math.inf)}
    if isinstance(low, float):
        return {"low_double": low, "high_double": high} if low <= high else {}
    return {"low_text": low, "high_text": high} if isinstance(low, str) else {}


def _joined(zones: list[dict]) -> dict:
    """One column's zones of all row groups as the file's. A group of nothing but nulls asks for no bounds."""
    nulls = [z["nulls"] for z in zones]
    out = {"nulls": None if None in nulls else sum(nulls)}
    some = [z for z in zones if z["nulls"] is None or z["nulls"] < z["rows"]]
    for i, name in enumerate(_BOUNDS):
        found = [z.get(name) for z in some]
        out[name] = None if not found or None in found else (max if i % 2 else min)(found)
    return out


def _zones(meta: pq.FileMetaData) -> list[dict]:
    out: dict[str, list] = {}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            column = group.column(c)
            stats = column.statistics if column.is_stats_set else None
            own = {"rows": column.num_values, "nulls": stats.null_count if stats is not None and stats.has_null_count else None}
            if stats is not None and stats.has_min_max:
                own |= _bounds(stats.min, stats.max)
            out.setdefault(column.path_in_schema, []).append(own)
    return [{"name": name} | _joined(zones) for name, zones in out.items()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zone = pa.struct([("name", pa.string()), ("nulls", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("low_double", pa.float64()), ("high_double", pa.float64()), ("low_text", pa.string()), ("high_text", pa.string())])
    schema = pa.schema([("file_path", pa.string()), ("file_size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("n_rows", pa.int64()), ("zones", pa.list_(zone))])
    for batch in batches:
        for i in range(batch.num_rows):
            path, size, modified = (batch.column(k)[i].as_py() for k in range(3))
            system, name = _opened(path)
            rows, zones = None, None
            with system.open_input_file(name) as f:
                try:
                    meta = pq.read_metadata(f)
                    rows, zones = meta.num_rows, _zones(meta)
                except pa.ArrowInvalid:
                    pass
            yield pa.RecordBatch.from_pylist([{"file_path": path, "file_size": size, "modified": modified, "n_rows": rows, "zones": zones}], schema)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own listing of the Parquet files below a path: file_path, file_size, modified. Files aren't opened, and many of them
    make one task: a session of its own packs them by their number instead of their bytes."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    files = session.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def refresh(spark: SparkSession, path: str, at: str) -> DataFrame:
    """The zone map of the Parquet files below path: file_path, file_size, modified, n_rows, zones. It is kept at `at`, to which the
    footers of files are added that it doesn't know (by path, size and time); files that are gone don't count."""
    keys = ["file_path", "file_size", "modified"]
    listed = _listed(spark, path)
    new = listed
    if exists(spark, at):
        new = listed.join(listed.sparkSession.read.schema(SCHEMA).parquet(at).select(*keys), keys, "left_anti")
    new.mapInArrow(_read, SCHEMA).write.mode("append").parquet(at)
    # Two refreshes at the same time add a file twice; one of its rows counts.
    known = listed.sparkSession.read.schema(SCHEMA).parquet(at).dropDuplicates(keys)
    return known.join(listed, keys, "left_semi").select(*known.columns)


def by_file(zones: DataFrame) -> DataFrame:
    """The plain manifest: file_path, file_size, n_rows."""
    return zones.select("file_path", "file_size", "n_rows")


def by_column(zones: DataFrame) -> DataFrame:
    """One row a file and column: file_path, n_rows, name, nulls, low, high (whole numbers, days, microseconds), low_double, high_double,
    low_text, high_text."""
    return zones.select("file_path", "n_rows", F.inline("zones"))


def _as_bound(spark: SparkSession, kind: str, value) -> tuple[str, object]:
    """A value, as a column of type kind has it, as a bound: its kind (`low` or `low_...`) and the number or text."""
    typed = F.lit(value).cast(kind)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # A fraction lies between two whole numbers; Spark would round it towards zero.
        return "low", value
    if kind == "date":
        name, x = "low", F.unix_date(typed)
    elif kind == "timestamp":
        name, x = "low", F.unix_micros(typed)
    elif kind == "timestamp_ntz":
        name, x = "low", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), typed)
    elif kind in ("float", "double") or kind.startswith("decimal"):
        name, x = "low_double", F.lit(value).cast("double")
    elif kind == "string":
        name, x = "low_text", typed
    else:
        return "", None
    return name, spark.range(1).select(x.alias("x")).first()[0]


def matching(zones: DataFrame, column: str, kind: str, low=None, high=None) -> DataFrame:
    """Files of a zone map that can hold a row with low <= column <= high (either may be left out), in columns of type kind."""
    spark = zones.sparkSession
    zone = F.get(F.filter("zones", lambda z: z["name"] == column), F.lit(0))
    void = F.coalesce(zone["nulls"] == F.col("n_rows"), F.lit(False)) | F.coalesce(F.col("n_rows") == 0, F.lit(False))
    out: Column = ~void
    for value, mine, over in ((low, "high", True), (high, "low", False)):
        if value is None:
            continue
        name, x = _as_bound(spark, kind, value)
        # NaN isn't in the bounds of doubles, and is over every lower bound.
        if x is None or (over and kind in ("float", "double")):
            continue
        field = zone[name.replace("low", mine)]
        out &= F.coalesce(field >= F.lit(x) if over else field <= F.lit(x), F.lit(True))
    return zones.filter(out)


def read_between(spark: SparkSession, path: str, zones: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows of the Parquet table at path with low <= column <= high, from the files that can hold some. The driver gets the names of
    those files, as it does in every read by Spark."""
    whole = spark.read.parquet(path)
    kind = dict(whole.dtypes)[column]
    paths = [r[0] for r in matching(zones, column, kind, low, high).select("file_path").collect()]
    reader = spark.read.schema(whole.schema)
    if not any(unquote(p).rstrip("/").endswith(path.rstrip("/")) for p in paths):
        reader = reader.option("basePath", path)
    rows = reader.parquet(*paths) if paths else whole.limit(0)
    for value, test in ((low, F.col(column) >= F.lit(low)), (high, F.col(column) <= F.lit(high))):
        rows = rows if value is None else rows.filter(test)
    return rows
