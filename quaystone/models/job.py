"""The training job: gold table in, a saved version out; and scoring with a saved version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.models import metrics as m
from quaystone.models import store
from quaystone.models import trees as t

FOLDS = 5


def run_training(spark: SparkSession, matrix: DataFrame, root: str, grid: list[dict] | None = None, params: dict | None = None, trees: int = t.TREES, backtest: bool = True) -> tuple[str, dict, DataFrame]:
    """Train, find anomalies, calibrate, explain, backtest and register: the version, its metrics and the backtest's report.

    matrix: the feature matrix of a gold table, read again and again. grid: settings of the parameter search, which is left out
    without them, without folds or with too few rows; params: the default setting. The backtest is of the setting that the model is
    trained with; the default setting in the same folds is the baseline. Both, and the whole search, are one training of many
    models. Without the backtest all scores are 0. The curve is fitted on the last fifth of the rows.
    """
    labelled = matrix.filter("is_disruption_week IS NOT NULL")
    n, share = labelled.agg(F.count("*"), F.avg("is_disruption_week")).first()
    if n < t.LEAST_ROWS:
        raise ValueError(f"too few labelled rows to train: {n}")
    splits = m.walk_forward(labelled.select("week_ending"), folds=FOLDS)
    settings = [params or {}, *(grid or [] if n >= t.LEAST_SEARCH else [])]
    found = t.cross_validated(labelled, splits, settings) if backtest else None
    tried = t.trial_scores(found[0]) if found else []
    # The default setting is only taken without a search.
    best = max(tried[1:] or tried, key=lambda x: (x[1], -x[0]), default=(0, 0.0, 0))
    report = spark.createDataFrame(t.report_of(labelled, splits, *found, trial=best[0]).collect() if found else [], t.REPORT)  # one row a fold
    mean = t.cv_score(report).first()
    model = t.train_gbt(labelled, settings[best[0]])
    forest = t.fit_forest(matrix, trees=trees).cache()  # trees * 2 * SAMPLE rows at most
    bounds = t.forest_bounds(matrix, forest)
    _, last = t.last_share(labelled)
    curve = t.fit_calibration(t.predict(model, last).select("p", F.col("is_disruption_week").alias("y")))
    top = t.importance(model, labelled, t.FEATURES).first()
    out = {
        "baseline_cv_pr_auc": tried[0][1] if tried else 0.0, "tuned_cv_pr_auc": best[1], "n_cv_folds": best[2], "n_train_rows": n, "n_features": len(t.FEATURES),
        "pos_rate": share, "calibrator_fitted": curve is not None, "backtest_mean_pr_auc": mean["cv_pr_auc"], "backtest_mean_roc_auc": mean["cv_roc_auc"], "top_feature": top["feature"], "trials": len(tried[1:]),
        "params": settings[best[0]],
    }
    version = store.save(spark, root, model, forest, bounds, curve, out)
    forest.unpersist()
    return version, out, report


def score_newest(spark: SparkSession, matrix: DataFrame, root: str, version: str | None = None) -> DataFrame:
    """The newest row of each port by a saved version (the champion by default): port_id, p_disruption (calibrated), anomaly_score,
    drivers and model_info."""
    b = store.load(spark, root, version)
    newest = matrix.join(F.broadcast(matrix.groupBy("port_id").agg(F.max("week_ending").alias("week_ending"))), ["port_id", "week_ending"], "left_semi")
    p = t.predict(b.model, newest).select("port_id", t.calibrated(F.col("p"), b.calibration).alias("p_disruption"))
    odd = t.forest_score(newest, b.forest, bounds=b.bounds).select("port_id", "anomaly_score")
    why = t.drivers(b.model, newest, t.FEATURES, ["port_id"]).select("port_id", "drivers")
    info = F.struct(F.lit(b.version).alias("version"), F.lit(float(b.metrics["tuned_cv_pr_auc"])).alias("cv_pr_auc"), F.lit(int(b.metrics["n_train_rows"])).cast("long").alias("n_train_rows"))
    return p.join(odd, "port_id").join(why, "port_id").withColumn("model_info", info)  # a row a port
