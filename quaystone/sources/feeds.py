"""Landed feeds to typed rows. Explicit schemas; what doesn't parse becomes null or goes, as stated."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.scalar import lenient, lookup
from quaystone.registry import SEVERITY_SCORE, TEU_COLUMNS

#: Columns of the headerless news export, in file order (fixed values of its publisher). The kept ones have a type other than string.
NEWS_COLUMNS = [
    "GlobalEventID", "SQLDATE", "MonthYear", "Year", "FractionDate",
    "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode", "Actor1EthnicCode", "Actor1Religion1Code", "Actor1Religion2Code", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code",
    "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode", "Actor2EthnicCode", "Actor2Religion1Code", "Actor2Religion2Code", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code",
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode", "Actor1Geo_ADM1Code", "Actor1Geo_Lat", "Actor1Geo_Long", "Actor1Geo_FeatureID",
    "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode", "Actor2Geo_ADM1Code", "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID",
    "ActionGeo_Type", "ActionGeo_FullName", "ActionGeo_CountryCode", "ActionGeo_ADM1Code", "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID", "DATEADDED", "SOURCEURL",
]
NEWS_KEPT = {
    "GlobalEventID": "long", "SQLDATE": "string", "EventCode": "string", "EventBaseCode": "string", "EventRootCode": "string", "GoldsteinScale": "double", "NumMentions": "long", "NumArticles": "long", "AvgTone": "double",
    "ActionGeo_FullName": "string", "ActionGeo_CountryCode": "string", "ActionGeo_Lat": "double", "ActionGeo_Long": "double", "SOURCEURL": "string",
}


def read_news_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The 14 kept columns; lines with another number of columns or with bad numbers go."""
    schema = ", ".join(f"`{c}` {NEWS_KEPT.get(c, 'string')}" for c in NEWS_COLUMNS)
    return spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").option("quote", "").csv(path).select(*NEWS_KEPT)


def _zip_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of all members of zip files, member by member as they unpack. A file that is cut off or fails its checksums gives none."""
    for batch in batches:
        for content in batch.column("content"):
            try:
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as packed:
                    if packed.testzip() is not None:
                        continue
                    for member in packed.infolist():
                        with packed.open(member) as f:
                            while lines := f.readlines(4 << 20):
                                text = [x.decode("utf-8", "replace").rstrip("\r\n") for x in lines]
                                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["value"])
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError):
                continue


def read_news_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_news_tsv() of zip files, as they are published: a task a file, whose packed bytes it holds, and rows as they unpack."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content") if path else spark.createDataFrame([], "content binary")
    schema = ", ".join(f"`{c}` {NEWS_KEPT.get(c, 'string')}" for c in NEWS_COLUMNS) + ", `__bad` string"
    options = {"sep": "\t", "quote": "", "columnNameOfCorruptRecord": "__bad"}
    rows = files.mapInArrow(_zip_lines, "value string").select(F.from_csv("value", schema, options).alias("r"))
    return rows.filter("r.__bad IS NULL").select(*[F.col("r")[c].alias(c) for c in NEWS_KEPT])


def read_fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; date and HHMM to a timestamp, lenient numbers, confidence n by default."""
    schema = "latitude string, longitude string, brightness string, acq_date string, acq_time string, satellite string, confidence string, frp string"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    mark = F.lower(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("n")))
    at = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    return raw.select(
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), lenient(F.col("brightness")).alias("brightness"), F.col("frp").try_cast("double").alias("frp"),
        F.coalesce(lookup(mark, {"l": "low", "n": "nominal", "h": "high"}), mark).alias("confidence"), "satellite", at.alias("acquired_at"),
    )


ALERT_GEOJSON = "features array<struct<id:string, properties:struct<event:string, severity:string, certainty:string, urgency:string, headline:string, description:string, areaDesc:string, effective:string, onset:string, expires:string, ends:string>>>"


def parse_alerts(raw: DataFrame) -> DataFrame:
    """value (GeoJSON text) to alerts with a known severity: id after the last slash, fallbacks where a field is empty."""
    f = raw.select(F.explode(F.from_json("value", ALERT_GEOJSON)["features"]).alias("f")).select("f.id", "f.properties.*")
    some = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    kept = f.filter(lookup(F.col("severity"), SEVERITY_SCORE, 0) >= 1)
    return kept.select(
        F.element_at(F.split("id", "/"), -1).alias("alert_id"), F.coalesce("event", F.lit("Unknown")).alias("event_type"), "severity", F.coalesce(some("headline", "event"), F.lit("")).alias("headline"),
        F.substring(F.coalesce("description", F.lit("")), 1, 1000).alias("description"), F.coalesce("areaDesc", F.lit("")).alias("area_description"),
        F.try_to_timestamp(some("effective", "onset")).alias("effective"), F.try_to_timestamp(some("expires", "ends")).alias("expires"),
    )


QUAKE_GEOJSON = "features array<struct<id:string, properties:struct<mag:double, magType:string, place:string, time:long, tsunami:int>, geometry:struct<coordinates:array<double>>>>"


def parse_quakes(raw: DataFrame) -> DataFrame:
    """value (GeoJSON text) to earthquakes; rows without id, magnitude, time or all three coordinates go."""
    f = raw.select(F.explode(F.from_json("value", QUAKE_GEOJSON)["features"]).alias("f")).select("f.id", "f.properties.*", "f.geometry.coordinates")
    at = lambda i: F.get("coordinates", F.lit(i))
    out = f.select(
        F.col("id").alias("usgs_id"), F.col("mag").alias("magnitude"), F.coalesce("magType", F.lit("unknown")).alias("mag_type"), at(2).alias("depth_km"), at(1).alias("lat"), at(0).alias("lon"),
        F.coalesce("place", F.lit("")).alias("place"), F.timestamp_millis("time").alias("occurred_at"), (F.coalesce("tsunami", F.lit(0)) != 0).alias("tsunami_flag"),
    )
    return out.dropna(subset=["usgs_id", "magnitude", "depth_km", "lat", "lon", "occurred_at"])


def typed_quakes(raw: DataFrame) -> DataFrame:
    """Snapshot rows of earthquakes, all text, to types; what doesn't parse is null."""
    number = {c: F.col(c).try_cast("double").alias(c) for c in ("magnitude", "depth_km", "lat", "lon")}
    flag = F.coalesce(F.lower("tsunami_flag").isin("true", "1"), F.lit(False)).alias("tsunami_flag")
    return raw.select("usgs_id", *number.values(), flag, F.try_to_timestamp("occurred_at").alias("occurred_at"))


def typed_fires(raw: DataFrame) -> DataFrame:
    """Snapshot rows of fire detections, all text, to types; what doesn't parse is null."""
    number = {c: F.col(c).try_cast("double").alias(c) for c in ("lat", "lon", "frp")}
    return raw.select(*number.values(), F.lower("confidence").alias("confidence"), F.try_to_timestamp("acquired_at").alias("acquired_at"))


def month_date(text):
    """Month in one of three forms to a date."""
    day = F.get(F.split(text, "T"), F.lit(0))
    return F.coalesce(F.try_to_timestamp(day, F.lit("M/d/yyyy")), F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("date")


def melt_teu(wide: DataFrame) -> DataFrame:
    """Wide months (port, one column a port) to port_id, month, teu: Long Beach into Los Angeles, empty months out."""
    first = next(iter(TEU_COLUMNS))
    dated = wide.withColumn("month", month_date(F.trim("port"))).withColumn(first, lenient(F.col(first)) + lenient(F.col("long_beach_ca")))
    cells = dated.select("month", *[lenient(F.col(c).cast("string")).alias(p) for c, p in TEU_COLUMNS.items()])
    long = cells.unpivot("month", list(TEU_COLUMNS.values()), "port_id", "teu")
    return long.filter("month IS NOT NULL AND teu > 0")


def union_drifting(*snapshots: DataFrame) -> DataFrame:
    """Snapshots whose columns differ, as one table; what a snapshot lacks is null."""
    out = snapshots[0]
    for more in snapshots[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
