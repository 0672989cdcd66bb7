"""Evaluation queries over predictions and gold rows, all with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone import adapters as a
from quaystone.adapters import sql
from quaystone.models import metrics as m
from quaystone.plans.features import gold_frame, gold_sql
from quaystone.plans.registry import query, rounded
from quaystone.registry import MODEL_COLUMNS

_STEPS = """SELECT fold, p, pos, n, sum(pos) OVER d AS tp, sum(n) OVER d AS seen, sum(pos) OVER (PARTITION BY fold) AS positives, sum(n) OVER (PARTITION BY fold) AS total
    FROM (SELECT fold, p, sum(y) AS pos, count(*) AS n FROM a_preds WHERE y IS NOT NULL GROUP BY fold, p) WINDOW d AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"""


def _preds_sql(body: str) -> str:
    return sql(body, "a_preds", s=_STEPS)


@query("ml_pr_curve", _preds_sql("SELECT fold, p AS threshold, round(tp::DOUBLE / seen, 6) AS precision, round(tp::DOUBLE / nullif(positives, 0), 6) AS recall FROM s"))
def ml_pr_curve(spark, sf_dir):
    return rounded(m.pr_curve(a.a_preds(spark, sf_dir), ["fold"]))


@query("ml_pr_auc", _preds_sql("SELECT fold, round(CASE WHEN max(positives) > 0 AND max(positives) < max(total) THEN sum(tp::DOUBLE / seen * pos) / max(positives) ELSE 0 END, 6) AS pr_auc FROM s GROUP BY fold"))
def ml_pr_auc(spark, sf_dir):
    return rounded(m.average_precision(a.a_preds(spark, sf_dir), ["fold"]))


@query("ml_roc_auc", _preds_sql("SELECT fold, round(CASE WHEN max(positives) > 0 AND max(positives) < max(total) THEN (sum(pos * (total - seen + (n + 1)::DOUBLE / 2)) - max(positives) * (max(positives) + 1)::DOUBLE / 2) / (max(positives) * (max(total) - max(positives)))::DOUBLE ELSE 0.5 END, 6) AS roc_auc FROM s GROUP BY fold"))
def ml_roc_auc(spark, sf_dir):
    return rounded(m.roc_auc(a.a_preds(spark, sf_dir), ["fold"]))


@query("ml_precision_at_k", sql("SELECT fold, round(avg(y), 6) AS precision_at_k FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p DESC, doc_id) AS rk FROM a_preds) WHERE rk <= 10 GROUP BY fold", "a_preds"))
def ml_precision_at_k(spark, sf_dir):
    return rounded(m.precision_at_k(a.a_preds(spark, sf_dir), ["fold"]))


@query("ml_calibration_bins", sql("SELECT least(floor(p * 10), 9)::INTEGER AS bin, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_share, count(*) AS n FROM a_preds GROUP BY 1", "a_preds"))
def ml_calibration_bins(spark, sf_dir):
    return rounded(m.reliability(a.a_preds(spark, sf_dir)))


_DRIFT_COLUMNS = ["median_berthing_time_hrs", "vessel_call_count", *MODEL_COLUMNS]
_REF, _CUR = "week_ending < DATE '2000-01-01'", "week_ending >= DATE '2000-01-01'"
_DRIFT = {"m": "avg({c}) FILTER ({r})", "s": "stddev_samp({c}) FILTER ({r})", "k": "avg({c}) FILTER ({w})", "d": "stddev_samp({c}) FILTER ({w})"}
_DRIFT_LISTS = ", ".join(f"unnest([{', '.join(e.format(c=c, r=_REF, w=_CUR) for c in _DRIFT_COLUMNS)}]) AS {k}" for k, e in _DRIFT.items())


def _shown(c: str) -> str:
    return f"CASE WHEN feature = 'eq_energy_proxy' THEN round({c}, 0) ELSE round({c}, 6) END"


@query("ml_drift", gold_sql(f"""SELECT feature, {_shown('m')} AS reference_mean, {_shown('s')} AS reference_std, {_shown('k')} AS current_mean, {_shown('d')} AS current_std, round(abs(k - m) / greatest(s, 1e-6), 6) AS z, abs(k - m) / greatest(s, 1e-6) > 2 AS drifted
    FROM (SELECT unnest([{', '.join(f"'{c}'" for c in _DRIFT_COLUMNS)}]) AS feature, {_DRIFT_LISTS} FROM g) WHERE m IS NOT NULL AND k IS NOT NULL"""))
def ml_drift(spark, sf_dir):
    """All columns of the model and the two that throughput gives."""
    out = m.drift_between(gold_frame(spark, sf_dir), F.expr(_REF), F.expr(_CUR), _DRIFT_COLUMNS)
    return out.select("feature", *[F.expr(_shown(c)).alias(c) for c in ("reference_mean", "reference_std", "current_mean", "current_std")], F.round("z", 6).alias("z"), "drifted")


@query("ml_class_weight", gold_sql("SELECT CASE WHEN sum(is_disruption_week) > 0 THEN round(count_if(is_disruption_week = 0)::DOUBLE / sum(is_disruption_week), 6) ELSE 1.0 END::DOUBLE AS class_weight FROM g"))
def ml_class_weight(spark, sf_dir):
    pos = F.sum("is_disruption_week")
    return gold_frame(spark, sf_dir).agg(F.when(pos > 0, F.round(F.count_if(F.col("is_disruption_week") == 0) / pos, 6)).otherwise(1.0).alias("class_weight"))


@query("ml_walk_forward_splits", sql("""SELECT fold, week_ending, role FROM (SELECT f.fold::INTEGER AS fold, week_ending, CASE WHEN w <= total - (5 - f.fold) * 4 THEN 'train' WHEN w <= total - (5 - f.fold) * 4 + 4 THEN 'test' END AS role, total - (5 - f.fold) * 4 AS start
    FROM (SELECT week_ending, row_number() OVER (ORDER BY week_ending) AS w, count(*) OVER () AS total FROM (SELECT DISTINCT week_ending FROM a_bts)), (SELECT unnest(range(5)) AS fold) f) WHERE role IS NOT NULL AND start >= 26""", "a_bts"))  # fmt: skip
def ml_walk_forward_splits(spark, sf_dir):
    return m.walk_forward(a.a_bts(spark, sf_dir).select("week_ending"))


@query("ml_champion", sql("""SELECT version, trained_at, pr_auc, became_champion, trained_at = max(CASE WHEN became_champion THEN trained_at END) OVER () AS is_champion
    FROM (SELECT *, coalesce(pr_auc > max(pr_auc) OVER (ORDER BY trained_at, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS became_champion FROM a_models)""", "a_models"))  # fmt: skip
def ml_champion(spark, sf_dir):
    return m.champions(a.a_models(spark, sf_dir))
