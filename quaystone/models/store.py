"""Model versions: what each training run saved, and which version serves.

A version is a folder with the node tables of the boosted trees and of the forest. Events (saved, promoted) are
entries of a commit log, so that several jobs can save at a time; the champion follows from it: the first version saved, then each that is strictly better than the champion of
its time, and any that was promoted by hand.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.models.boosting import NODES, Model, model_of, node_table
from quaystone.models.trees import FEATURES, FOREST
from quaystone.sources import commits

LOG = "version string, event string, at timestamp, seq long, pr_auc double, n_train_rows long, feature_count int, metrics string, calibration string, forest_low double, forest_high double"
_SAVED = ("pr_auc", "n_train_rows", "feature_count", "metrics", "calibration", "forest_low", "forest_high")


class Bundle(NamedTuple):
    """What serving needs of a version."""

    version: str
    model: Model
    forest: DataFrame
    bounds: tuple[float, float]
    calibration: dict | None
    metrics: dict


def _events(spark: SparkSession, root: str) -> DataFrame:
    """One row an event, in the order of the log's numbers."""
    rows = [(e["version"], e["event"], dt.datetime.fromisoformat(e["at"]), e["number"], *[e.get(c) for c in _SAVED]) for e in commits.entries(spark, f"{root}/log")]
    return spark.createDataFrame(rows, LOG)


def _log(spark: SparkSession, root: str, version: str, event: str, *rest) -> None:
    at = dt.datetime.now().isoformat()
    commits.commit(spark, f"{root}/log", {"version": version, "event": event, "at": at} | dict(zip(_SAVED, rest, strict=False)))


def save(spark: SparkSession, root: str, model, forest: DataFrame, bounds: tuple[float, float], calibration: dict | None, metrics: dict) -> str:
    """Save a version below root and return its name. metrics holds tuned_cv_pr_auc, n_train_rows and n_features, and what else there is."""
    version = f"v{dt.datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/trees")
    forest.coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/forest")
    _log(spark, root, version, "saved", float(metrics["tuned_cv_pr_auc"]), int(metrics["n_train_rows"]), int(metrics["n_features"]), json.dumps(metrics), json.dumps(calibration), *map(float, bounds))
    return version


def promote(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the champion by hand. A ValueError if there is no such version."""
    if _events(spark, root).filter((F.col("version") == version) & (F.col("event") == "saved")).isEmpty():
        raise ValueError(f"no version {version!r}")
    _log(spark, root, version, "promoted")


def champion(spark: SparkSession, root: str) -> str | None:
    """The version that serves, None before the first was saved."""
    best, score = None, None
    scores: dict[str, float] = {}
    for r in _events(spark, root).orderBy("seq").select("version", "event", "pr_auc").collect():  # one row an event
        if r["event"] == "saved":
            scores[r["version"]] = r["pr_auc"]
            if best is not None and not r["pr_auc"] > score:
                continue
        best, score = r["version"], scores[r["version"]]
    return best


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions, the newest first: version, trained_at, is_champion, cv_pr_auc, n_train_rows, feature_count."""
    best = champion(spark, root)
    saved = _events(spark, root).filter("event = 'saved'")
    return saved.orderBy(F.desc("seq")).select("version", F.col("at").alias("trained_at"), (F.col("version") == F.lit(best)).alias("is_champion"), F.col("pr_auc").alias("cv_pr_auc"), "n_train_rows", "feature_count")


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """A version, by default the champion. A RuntimeError without any, a ValueError if there is no such version."""
    version = version or champion(spark, root)
    if version is None:
        raise RuntimeError("no version was saved")
    row = _events(spark, root).filter((F.col("version") == version) & (F.col("event") == "saved")).first()
    if row is None:
        raise ValueError(f"no version {version!r}")
    forest = spark.read.schema(FOREST).parquet(f"{root}/{version}/forest")
    return Bundle(version, model_of(spark.read.schema(NODES).parquet(f"{root}/{version}/trees"), json.loads(row["metrics"]).get("columns", FEATURES)), forest, (row["forest_low"], row["forest_high"]), json.loads(row["calibration"]), json.loads(row["metrics"]))
