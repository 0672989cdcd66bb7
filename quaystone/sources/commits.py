"""A commit log: numbered entries that several writers add at the same time.

An entry is a file of one JSON object, named by its number. It is written whole under another name and then put in place only if
that number is free; a writer that comes second tries the next number. So no entry is lost, numbers have no gaps, and readers see
whole entries only. Tables are added the same way: rows go to a folder of their own first, and the entry that names it makes
them count; a writer that fails or runs again leaves at most a folder that nothing names.

Needs a file system that puts files in place without replacing others: local ones (by hard links) and those whose rename fails on
an existing file, as HDFS.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Writers that come second to a number before they give up.
TRIES = 1000


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; whether it was written. It appears whole or not at all."""
    folder, name = path.rsplit("/", 1)
    aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    place = _local(path)
    if place is not None:
        aside = _local(aside)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(aside, place)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    system = fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(fs.Path(aside), True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        files.rename(fs.Path(aside), fs.Path(path), spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        system.delete(fs.Path(aside), False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def entries(spark: SparkSession, folder: str) -> list[dict]:
    """All entries of a log in order, each with its number. A log is small: one entry a commit."""
    place = _local(folder)
    if place is not None:
        names = os.listdir(place) if os.path.isdir(place) else []
        found = {n: open(f"{place}/{n}", encoding="utf-8").read() for n in names if n.endswith(".json") and n[0] != "_"}  # noqa: SIM115
    else:
        fs = spark._jvm.org.apache.hadoop.fs
        path = fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = {r[0].rsplit("/", 1)[1]: r[1] for r in spark.read.text(f"{folder}/*.json", wholetext=True).select("_metadata.file_path", "value").collect()}
    return [json.loads(found[n]) | {"number": int(n[:-5])} for n in sorted(found)]


def commit(spark: SparkSession, folder: str, entry: dict, unless: Callable[[list[dict]], bool] | None = None) -> int | None:
    """Add an entry and return its number. unless: looks at all entries before this one; where it holds, nothing is added, and the
    result is None. As the log is looked at again after each number that went to another writer, the two can't both be right."""
    for _ in range(TRIES):
        before = entries(spark, folder)
        if unless and unless(before):
            return None
        number = before[-1]["number"] + 1 if before else 0
        if put_if_absent(spark, f"{folder}/{number:010d}.json", json.dumps(entry)):
            return number
    raise RuntimeError(f"no free number in {folder} after {TRIES} tries")


def write_rows(df: DataFrame, root: str, name: str = "rows") -> str:
    """Rows in a folder of their own below root, which counts once an entry names it; the folder, relative to root."""
    path = f"{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{path}")
    return path


def append_rows(df: DataFrame, root: str, **entry) -> int:
    """Add rows to the table at root by one commit; its number."""
    return commit(df.sparkSession, f"{root}/log", entry | {"rows": write_rows(df, root)})


def read_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of all commits of the table at root, with the number of their commit."""
    known = {e["rows"].rsplit("/", 1)[1]: e for e in entries(spark, f"{root}/log") if "rows" in e}
    if not known:
        return spark.createDataFrame([], schema).withColumn("commit", F.lit(None).cast("long"))
    df = spark.read.schema(schema).parquet(*[f"{root}/{e['rows']}" for e in known.values()])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    numbers = spark.createDataFrame([(k, e["number"]) for k, e in known.items()], "__folder string, commit long")
    return df.withColumn("__folder", folder).join(numbers, "__folder").drop("__folder")
