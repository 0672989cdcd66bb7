"""Model queries: fits are not SQL, so these have no oracle; tests hold their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.models import job, store
from quaystone.models import metrics as m
from quaystone.models import trees as t
from quaystone.plans.features import feature_matrix, gold_frame, impact_table
from quaystone.plans.registry import query
from quaystone.plans.scoring import signals
from quaystone.registry import ANOMALY_COLUMNS
from quaystone.scoring import cards as c
from quaystone.sources import lake
from quaystone.sources.lake import scratch

FOLDS = job.FOLDS


def matrix(spark, sf_dir) -> DataFrame:
    """The feature matrix of the gold table in the lake, written once: every fit below reads it again and again."""
    root = scratch(spark)
    lake.write_gold(gold_frame(spark, sf_dir), root)
    feature_matrix(lake.read_gold(spark, root)).write.mode("overwrite").parquet(f"{root}/matrix")
    return spark.read.parquet(f"{root}/matrix")


def labelled(rows: DataFrame) -> DataFrame:
    return rows.filter("is_disruption_week IS NOT NULL")


@query("ml_gbt_predict")
def ml_gbt_predict(spark, sf_dir):
    rows = labelled(matrix(spark, sf_dir))
    return t.predict(t.train_gbt(rows), rows).select("port_id", "week_ending", "is_disruption_week", "p")


def _folds(rows: DataFrame) -> DataFrame:
    return m.walk_forward(rows.select("week_ending"), folds=FOLDS)


@query("ml_backtest")
def ml_backtest(spark, sf_dir):
    rows = labelled(matrix(spark, sf_dir))
    return t.fold_report(rows, _folds(rows))


@query("ml_cv_score")
def ml_cv_score(spark, sf_dir):
    rows = labelled(matrix(spark, sf_dir))
    return t.cv_score(t.fold_report(rows, _folds(rows)))


@query("ml_param_search")
def ml_param_search(spark, sf_dir):
    """30 settings of all eight parameters over five folds: 150 models at once."""
    rows = labelled(matrix(spark, sf_dir))
    return t.search(rows, _folds(rows), t.settings())


@query("ml_calibrate")
def ml_calibrate(spark, sf_dir):
    """Trained on the earlier rows, calibrated on the last fifth."""
    before, last = t.last_share(labelled(matrix(spark, sf_dir)))
    scored = t.predict(t.train_gbt(before), last).select("port_id", "week_ending", F.col("is_disruption_week").alias("y"), "p")
    return t.calibrate(t.calibrate(scored, "isotonic").withColumnRenamed("calibrated", "isotonic")).select("port_id", "week_ending", "y", "p", "calibrated", "isotonic")


@query("ml_iforest")
def ml_iforest(spark, sf_dir):
    rows = matrix(spark, sf_dir)
    scored = t.forest_score(rows, t.fit_forest(rows), ANOMALY_COLUMNS)
    return t.with_outliers(scored).select("port_id", "week_ending", "anomaly_score", (F.col("anomaly_score") > 0.7).alias("is_anomaly"), "is_outlier")


@query("ml_anomaly_share")
def ml_anomaly_share(spark, sf_dir):
    """Rows, and the shares that the contamination and the fixed threshold mark."""
    scored = ml_iforest(spark, sf_dir)
    return scored.agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"), F.avg(F.col("is_outlier").cast("int")).alias("outlier_share"), F.count_if("is_anomaly").alias("anomalies"))


@query("ml_drivers")
def ml_drivers(spark, sf_dir):
    rows = labelled(matrix(spark, sf_dir))
    return t.drivers(t.train_gbt(rows), rows, t.FEATURES, ["port_id", "week_ending"])


@query("ml_importance")
def ml_importance(spark, sf_dir):
    """Mean absolute attribution of each feature over all labelled rows."""
    rows = labelled(matrix(spark, sf_dir))
    return t.importance(t.train_gbt(rows), rows, t.FEATURES)


@query("ml_training_job")
def ml_training_job(spark, sf_dir):
    """Load, train, anomaly, calibrate, explain, backtest and register, with the search of ml_param_search; the registry's versions."""
    root = f"{scratch(spark)}/models"
    job.run_training(spark, matrix(spark, sf_dir), root, t.settings())
    return store.versions(spark, root).select("is_champion", "cv_pr_auc", "n_train_rows", "feature_count")


@query("sc_risk_card_model")
def sc_risk_card_model(spark, sf_dir):
    """Cards with a model: train, register, and score each port's newest week with the champion. ml_backtest has the backtest."""
    rows, root = matrix(spark, sf_dir), f"{scratch(spark)}/models"
    job.run_training(spark, rows, root, backtest=False)
    found = job.score_newest(spark, rows, root)
    return c.cards(impact_table(spark), c.latest(rows), signals(spark, sf_dir), found).select("port_id", "risk_score", "risk_tier", "p_disruption", "anomaly_score", "confidence_score", "confidence_flags", c.shown_drivers(F.col("drivers")).alias("drivers"), "card_id", "generated_at", F.col("model_info.n_train_rows").alias("n_train_rows"))
