"""Facts about splits, metrics, forests and attributions."""

import datetime as dt
import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone import plans
from quaystone.models import job, store
from quaystone.models import metrics as m
from quaystone.models import trees as t


def preds(spark, y, s):
    return spark.createDataFrame([(0, i, a, float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))], "fold int, doc_id long, y int, p double")


def test_metrics(spark):
    perfect = preds(spark, [0, 1, 1, 0, 0, 1], [0.31, 0.64, 0.93, 0.05, 0.22, 0.57])
    assert m.average_precision(perfect, ["fold"]).first().pr_auc == 1.0 and m.roc_auc(perfect, ["fold"]).first().roc_auc == 1.0
    single = preds(spark, [0] * 7, [0.13 * i for i in range(7)])
    assert m.average_precision(single, ["fold"]).first().pr_auc == 0.0 and m.roc_auc(single, ["fold"]).first().roc_auc == 0.5
    s = [0.12, 0.77, 0.41, 0.95, 0.06, 0.58]
    assert m.precision_at_k(preds(spark, [0, 1, 0, 1, 0, 0], s), ["fold"], 2).first().precision_at_k == 1.0
    assert m.precision_at_k(preds(spark, [1, 0, 1, 0, 1, 1], s), ["fold"], 2).first().precision_at_k == 0.0
    assert m.reliability(preds(spark, [0, 1], [0.1, 0.9])).count() == 0


def test_metrics_with_ties_against_plain_sums(spark):
    rng = random.Random(2)
    # Steps within and across the ranges of the two-level sums, and scores outside 0 to 1.
    y, s = [rng.randint(0, 1) for _ in range(300)], [rng.choice([rng.randint(0, 9) / 10, rng.randint(0, 30) / 10_000, -0.5, 1.7]) for _ in range(300)]
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, tp, seen = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        hits = sum(a for a, b in zip(y, s) if b == v)
        tp, seen = tp + hits, seen + s.count(v)
        ap += hits / len(pos) * tp / seen
    assert abs(m.roc_auc(preds(spark, y, s), ["fold"]).first().roc_auc - auc) < 1e-12
    assert abs(m.average_precision(preds(spark, y, s), ["fold"]).first().pr_auc - ap) < 1e-12


def test_drift(spark):
    one, hundred = spark.createDataFrame([(1.0,)] * 50, "x double"), spark.createDataFrame([(100.0,)] * 50, "x double")
    assert m.drift(one, hundred, ["x"]).first().drifted and not m.drift(one, one, ["x"]).first().drifted


def test_drift_comes_in_order(spark):
    rows = [(float(i % 5), float(i % 7) + 10 * (i >= 50), i >= 50) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, later boolean")
    got = m.drift_between(df, ~F.col("later"), F.col("later"), ["a", "b"]).collect()
    two = m.drift(df.filter("NOT later"), df.filter("later"), ["a", "b"]).collect()
    assert [r.feature for r in got] == ["b", "a"] and got[0].drifted and not got[1].drifted and got == two


def test_walk_forward(spark):
    weeks = lambda n: spark.createDataFrame([(dt.date(2022, 1, 2) + dt.timedelta(weeks=i),) for i in range(n)], "week_ending date")
    rows = m.walk_forward(weeks(80)).collect()
    for fold in range(5):
        train = [r.week_ending for r in rows if (r.fold, r.role) == (fold, "train")]
        test = [r.week_ending for r in rows if (r.fold, r.role) == (fold, "test")]
        assert len(test) == 4 and len(train) >= 26 and max(train) < min(test)
    assert m.walk_forward(weeks(10)).count() == 0


def test_champions(spark):
    v = spark.createDataFrame([("a", dt.date(2024, 1, 1), 0.5), ("b", dt.date(2024, 1, 2), 0.5), ("c", dt.date(2024, 1, 3), 0.7), ("d", dt.date(2024, 1, 4), 0.6)], "version string, trained_at date, pr_auc double")
    assert [r.version for r in m.champions(v).filter("is_champion").collect()] == ["c"]
    assert [r.version for r in m.champions(v, promoted="d").filter("is_champion").collect()] == ["d"]


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000, 9.0, -9.0), (1001, None, 12.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    forest = t.fit_forest(df, ["x", "y"], trees=30, sample=64, keys=["id"])
    scored = t.forest_score(df, forest, ["x", "y"])
    got = {r.id: r.anomaly_score for r in scored.collect()}
    usual = np.mean([v for k, v in got.items() if k < 1000])
    assert 0 <= min(got.values()) and max(got.values()) <= 1 and got[1000] > 0.7 > usual and got[1001] > usual
    marked = t.with_outliers(scored, 0.05).filter("is_outlier").collect()
    assert 15 <= len(marked) <= 21 and {1000, 1001} <= {r.id for r in marked}
    # New rows are scaled to the training rows, not to themselves.
    bounds = t.forest_bounds(df, forest, ["x", "y"])
    assert abs(t.forest_score(df.filter("id = 5"), forest, ["x", "y"], bounds).first().anomaly_score - got[5]) < 1e-12
    assert t.forest_score(df.limit(0), forest, ["x", "y"]).count() == 0


def test_forest_samples_repeated_rows(spark):
    """Rows that are equal in value are drawn one by one, at small and at large sizes."""
    same = spark.range(19_000).selectExpr("id", "0.0D AS x", "0.0D AS y")
    rest = spark.range(19_000, 20_000).selectExpr("id", "rand(1) AS x", "rand(2) AS y")
    df = same.union(rest)
    for trees, sample in ((20, 256), (5, 64)):
        assert (20_000 > 4 * trees * sample) == (trees == 5)
        nodes = t.fit_forest(df, ["x", "y"], trees=trees, sample=sample, keys=["id"]).collect()
        assert [r["size"] for r in sorted(nodes) if r.node == 0] == [sample] * trees
        leaves = {}
        for r in nodes:
            if r.feature < 0:
                leaves[r.tree] = max(leaves.get(r.tree, 0), r["size"])
        assert all(0.8 * sample < v < sample for v in leaves.values())  # 95 % of the rows are one point
    assert [r["size"] for r in t.fit_forest(df.limit(10), ["x", "y"], trees=3, sample=64, keys=["id"]).filter("node = 0").collect()] == [10] * 3


def test_forest_splits_values_that_differ_in_the_last_bit(spark):
    """Sums in another order differ by a bit: no double lies between two such values, and both sides of the split have rows."""
    near = float(np.nextafter(25.5, 26))
    assert all(25.5 < t._cut(25.5, near, share) <= near for share in (0.0, 0.2, 0.7, 1 - 2**-53))
    rows = [(i, near if i % 2 else 25.5, float(i // 32)) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    nodes = t.fit_forest(df, ["x", "y"], trees=30, keys=["id"]).collect()
    assert len({r.tree for r in nodes}) == 30 and all(r["size"] > 0 for r in nodes)
    assert {r["size"] for r in nodes if r.feature < 0} == {16}  # four different rows
    assert t.forest_score(df, t.fit_forest(df, ["x", "y"], trees=30, keys=["id"]), ["x", "y"]).select("anomaly_score").distinct().count() <= 4


def test_forest_of_values_that_are_not_finite(spark):
    odd = {3: float("inf"), 4: float("-inf"), 5: float("nan"), 6: 1.7e308, 7: -1.7e308}
    rows = [(i, odd.get(i, i / 100), float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    forest = t.fit_forest(df, ["x", "y"], trees=30, keys=["id"])
    got = {r.id: r.anomaly_score for r in t.forest_score(df, forest, ["x", "y"]).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and min(got[3], got[4]) > np.mean(list(got.values()))
    plain = df.filter("id NOT IN (3, 4, 5, 6, 7)")
    zero = plain.union(spark.createDataFrame([(5, 0.0, 5.0)], df.schema))
    same = plain.union(df.filter("id = 5"))
    assert sorted(t.fit_forest(zero, ["x", "y"], trees=3, keys=["id"]).collect()) == sorted(t.fit_forest(same, ["x", "y"], trees=3, keys=["id"]).collect())


def test_attributions_add_up_and_match_model(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)]
    df = spark.createDataFrame([(*r, int(r[1] + 0.5 * r[2] > 0)) for r in rows], "id long, a double, b double, c double, is_disruption_week int")
    cols = ["a", "b", "c"]
    model = t.train_gbt(df, {"n_estimators": 3, "max_depth": 3}, cols, ["id"])
    got = t.drivers(model, df, cols, ["id"]).collect()
    p = {r.id: r.p for r in t.predict(model, df).collect()}
    for r in got:
        assert abs(r.base + r.total_impact - r.margin) < 1e-9
        assert abs(1 / (1 + np.exp(-r.margin)) - p[r.id]) < 1e-9
    assert np.mean([r.drivers[0].feature == "a" for r in got]) > 0.5


def test_importance_is_the_mean_of_attributions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, *map(float, r), int(r[1] > 0)) for i, r in enumerate(rng.normal(size=(200, 3)))], "id long, a double, b double, c double, is_disruption_week int").repartition(3)
    cols = ["a", "b", "c"]
    model = t.train_gbt(df, {"n_estimators": 3, "max_depth": 3}, cols, ["id"])
    got = t.importance(model, df, cols).collect()
    parts = np.abs(t.attributions(np.array([[r.a, r.b, r.c] for r in df.collect()]), t.node_tables(model))).mean(axis=0)
    assert got[0].feature == "b" and [r.mean_impact for r in got] == sorted((r.mean_impact for r in got), reverse=True) and all(r.n == 200 for r in got)
    assert all(abs(r.mean_impact - parts[cols.index(r.feature)]) < 1e-12 for r in got)


def test_guards(spark):
    few = spark.createDataFrame([(float(i), i % 2) for i in range(9)], "a double, is_disruption_week int")
    with pytest.raises(ValueError):
        t.train_gbt(few, columns=["a"], keys=["a"])
    p = spark.createDataFrame([(i / 30, int(i > 12)) for i in range(30)], "p double, y int")
    assert t.fit_calibration(p.limit(19)) is None and t.fit_calibration(p.filter("y = 1").union(p.filter("y = 1"))) is None
    assert [r.calibrated for r in t.calibrate(p.limit(5)).collect()] == [r.p for r in p.limit(5).collect()]
    for method in ("sigmoid", "isotonic"):
        got = [r.calibrated for r in t.calibrate(p, method).orderBy("p").collect()]
        assert all(0 <= x <= 1 for x in got) and got == sorted(got) and got[0] < 0.2 < 0.8 < got[-1]
    weeks = [dt.date(2022, 1, 2) + dt.timedelta(weeks=i) for i in range(80)]
    flat = spark.createDataFrame([(w, "x", float(i), int(i % 2 and i < 70)) for i, w in enumerate(weeks)], "week_ending date, port_id string, a double, is_disruption_week int")
    splits = m.walk_forward(flat.select("week_ending"))
    # Test weeks from the 72nd on hold one class, so their folds are left out, though both classes are in the training rows.
    folded = t.with_folds(flat, splits)
    assert list(t.usable_folds(folded, 20)) == [0, 1, 2] and t.usable_folds(folded, 1000) == {}
    assert t.usable_folds(folded)[0] == 60 / 30 - 1
    assert t.search(flat.limit(79), splits, [{}], ["a"]).count() == 0 and t.search(flat, splits, [], ["a"]).count() == 0
    empty = t.fold_report(flat, splits.limit(0), columns=["a"])
    assert empty.count() == 0 and t.cv_score(empty).first().asDict() == {"cv_pr_auc": 0.0, "cv_roc_auc": 0.0, "folds": 0}


def test_budgets():
    """The registered queries use the whole budget: 30 settings of eight parameters, five folds, 200 trees."""
    from quaystone.plans import training

    whole = t.settings()
    names = {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "min_child_weight", "reg_alpha", "reg_lambda"}
    assert len(whole) == 30 and all(set(g) == names for g in whole) and all(len({g[k] for g in whole}) > 1 for k in names)
    assert max(g["n_estimators"] for g in whole) > 300 and min(g["n_estimators"] for g in whole) >= 50 and {g["max_depth"] for g in whole} == {3, 4, 5, 6, 7, 8}
    assert training.FOLDS == 5 and (t.DEFAULTS["n_estimators"], t.DEFAULTS["max_depth"], t.DEFAULTS["learning_rate"], t.TREES) == (200, 5, 0.05, 200)


SMALL = {"n_estimators": 2, "max_depth": 2}


@pytest.fixture(scope="module")
def matrix(spark):
    from quaystone.plans.features import feature_matrix, gold_frame

    rows = feature_matrix(gold_frame(spark, "/root/testdata/sf0.001")).collect()
    return spark.createDataFrame(rows).repartition(2).cache()


def test_versions(spark, tmp_path, matrix):
    root = str(tmp_path / "models")
    known = matrix.filter("is_disruption_week IS NOT NULL")
    model, forest = t.train_gbt(known, SMALL), t.fit_forest(matrix, trees=3, sample=32)
    bounds = t.forest_bounds(matrix, forest)
    assert store.champion(spark, root) is None and store.versions(spark, root).count() == 0
    with pytest.raises(RuntimeError):
        store.load(spark, root)
    put = lambda score: store.save(spark, root, model, forest, bounds, {"method": "sigmoid", "x": [2.0], "y": [-1.0]}, {"tuned_cv_pr_auc": score, "n_train_rows": 7, "n_features": 33})
    a, b, c = put(0.5), put(0.5), put(0.7)
    assert store.champion(spark, root) == c
    store.promote(spark, root, b)
    assert store.champion(spark, root) == b and put(0.4) != b and store.champion(spark, root) == b
    d = put(0.6)  # better than the one promoted, though not than the best
    assert store.champion(spark, root) == d
    listed = store.versions(spark, root).collect()
    assert [r.version for r in listed][0] == d and listed[-1].version == a and [r.version for r in listed if r.is_champion] == [d] and listed[0].cv_pr_auc == 0.6
    with pytest.raises(ValueError):
        store.promote(spark, root, "v0")
    with pytest.raises(ValueError):
        store.load(spark, root, "v0")
    back = store.load(spark, root, a)
    assert back.bounds == bounds and back.calibration["x"] == [2.0] and back.metrics["n_features"] == 33
    assert [r.p for r in t.predict(back.model, known).orderBy("port_id", "week_ending").collect()] == [r.p for r in t.predict(model, known).orderBy("port_id", "week_ending").collect()]
    assert sorted(back.forest.collect()) == sorted(forest.collect())


def test_training_job(spark, tmp_path, matrix):
    root = str(tmp_path / "models")
    version, found, report = job.run_training(spark, matrix, root, [SMALL, SMALL | {"max_depth": 1}], SMALL, trees=5)
    assert store.champion(spark, root) == version and found["trials"] == 2 and found["n_cv_folds"] == report.count() > 0 and found["n_features"] == 33
    assert 0 <= found["tuned_cv_pr_auc"] <= 1 and abs(found["backtest_mean_roc_auc"] - np.mean([r.roc_auc for r in report.collect()])) < 1e-12
    scored = job.score_newest(spark, matrix, root).collect()
    assert len(scored) == 10 and all(0 <= r.p_disruption <= 1 and 0 <= r.anomaly_score <= 1 and len(r.drivers) == 5 for r in scored)
    with pytest.raises(ValueError):
        job.run_training(spark, matrix.limit(5), root)


@pytest.mark.parametrize("name", ["ml_gbt_predict", "ml_backtest", "ml_cv_score", "ml_param_search", "ml_calibrate", "ml_iforest", "ml_anomaly_share", "ml_drivers", "ml_importance", "ml_training_job", "sc_risk_card_model"])
def test_model_queries(spark, monkeypatch, matrix, name):
    """Every model query, with few and small trees: its rows and ranges."""
    from quaystone.plans import training

    monkeypatch.setattr(training, "matrix", lambda spark, sf_dir: matrix)
    monkeypatch.setattr(t, "DEFAULTS", t.DEFAULTS | SMALL)
    monkeypatch.setattr(t, "settings", lambda: [SMALL, SMALL | {"max_depth": 1}])
    rows = plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    known = matrix.filter("is_disruption_week IS NOT NULL").count()
    sizes = {"ml_gbt_predict": known, "ml_cv_score": 1, "ml_param_search": 2, "ml_iforest": matrix.count(), "ml_anomaly_share": 1, "ml_drivers": known, "ml_importance": 33, "ml_training_job": 1, "sc_risk_card_model": 10}
    assert len(rows) == sizes.get(name, len(rows)) and rows
    for c in ("p", "calibrated", "isotonic", "anomaly_score", "pr_auc", "roc_auc", "cv_pr_auc", "cv_roc_auc", "mean_pr_auc", "p_disruption", "outlier_share"):
        assert all(0 <= r[c] <= 1 for r in rows if c in r)
    if name == "ml_drivers":
        assert all(len(r.drivers) == 5 and abs(r.base + r.total_impact - r.margin) < 1e-9 for r in rows)
    if name == "ml_anomaly_share":
        assert rows[0].n == matrix.count() and 0.03 <= rows[0].outlier_share <= 0.051
    if name == "ml_backtest":
        assert [r.fold for r in rows] == sorted(r.fold for r in rows) and all(r.train_end < r.test_start for r in rows)


@pytest.mark.parametrize("name", ["ml_iforest", "ml_anomaly_share", "ml_training_job", "sc_risk_card_model"])
def test_queries_of_nearly_equal_values(spark, monkeypatch, matrix, name):
    """Anomaly columns that differ between rows in one column's last bit only."""
    from quaystone.plans import training
    from quaystone.registry import ANOMALY_COLUMNS

    first, near = ANOMALY_COLUMNS[0], float(np.nextafter(25.5, 26))
    same = matrix.withColumns({c: F.lit(0.0) for c in ANOMALY_COLUMNS}).withColumn(first, F.when(F.xxhash64("port_id", "week_ending") % 2 == 0, 25.5).otherwise(near))
    monkeypatch.setattr(training, "matrix", lambda spark, sf_dir: same)
    monkeypatch.setattr(t, "DEFAULTS", t.DEFAULTS | SMALL)
    monkeypatch.setattr(t, "settings", lambda: [SMALL])
    rows = plans.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    n = matrix.count()
    assert len(rows) == {"ml_iforest": n, "ml_anomaly_share": 1, "ml_training_job": 1, "sc_risk_card_model": 10}[name]
    if name == "ml_iforest":
        assert {r.anomaly_score for r in rows} == {0.0, 1.0}
    if name == "ml_anomaly_share":
        assert rows[0].n == n and 0 < rows[0].anomalies < n


def test_report_and_search_over_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2022, 1, 2) + dt.timedelta(weeks=i // 4), str(i % 4), *map(float, rng.normal(size=2))) for i in range(240)]
    df = spark.createDataFrame([(*r, int(r[2] > 0)) for r in rows], "week_ending date, port_id string, a double, b double, is_disruption_week int")
    splits = m.walk_forward(df.select("week_ending"))
    small = {"n_estimators": 1, "max_depth": 2}
    report = t.fold_report(df, splits, small, columns=["a", "b"]).collect()
    assert [(r.fold, r.n_train, r.n_test) for r in report] == [(f, 4 * (40 + 4 * f), 16) for f in range(5)]
    assert all(r.train_start == dt.date(2022, 1, 2) and r.train_end < r.test_start <= r.test_end for r in report)
    found = t.search(df, splits, [small, small | {"max_depth": 1}], ["a", "b"]).collect()
    assert [(r.trial, r.folds) for r in found] == [(0, 5), (1, 5)]
    assert abs(found[0].mean_pr_auc - np.mean([r.pr_auc for r in report])) < 1e-9
    assert t.search(df, splits.limit(0), [small], ["a", "b"]).count() == 0


def grown(rng, depth, features):
    """A tree with a random feature at each node and random covers."""
    t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def grow(left, cover):
        me = len(t["feature"])
        leaf = left == 0 or (left < depth and rng.random() < 0.1)
        for k, v in (("feature", -1 if leaf else int(rng.integers(features))), ("threshold", float(rng.normal())), ("left", -1), ("right", -1), ("value", float(rng.normal())), ("cover", cover)):
            t[k].append(v)
        if not leaf:
            share = rng.uniform(0.1, 0.9)
            t["left"][me] = grow(left - 1, cover * share)
            t["right"][me] = grow(left - 1, cover * (1 - share))
        return me

    grow(depth, 100.0)
    return {k: np.array(v) for k, v in t.items()}


def by_subsets(x, tree, features):
    """Shapley values by all subsets of the features."""
    out = np.zeros_like(x)
    value = {s: t._expected(tree, x, frozenset(s)) for k in range(features + 1) for s in combinations(range(features), k)}
    for s in value:
        for f in set(range(features)) - set(s):
            out[:, f] += factorial(len(s)) * factorial(features - len(s) - 1) / factorial(features) * (value[tuple(sorted({*s, f}))] - value[s])
    return out


def test_attributions_against_all_subsets():
    rng = np.random.default_rng(5)
    for depth in (0, 1, 2, 4, 6):
        x, trees = rng.normal(size=(30, 6)), [(w, grown(rng, depth, 6)) for w in (1.0, 0.1)]
        want = sum(w * by_subsets(x, tree, 6) for w, tree in trees)
        assert np.abs(t.attributions(x, trees) - want).max() < 1e-9


def test_attributions_of_deep_trees_take_few_walks(monkeypatch):
    rng, plain, calls = np.random.default_rng(6), t._expected, [0]

    def counted(*args):
        calls[0] += 1
        assert calls[0] < 100_000
        return plain(*args)

    x, tree = rng.normal(size=(50, 40)), grown(rng, 8, 40)
    monkeypatch.setattr(t, "_expected", counted)
    parts = t.attributions(x, [(1.0, tree)])
    assert len(set(tree["feature"]) - {-1}) > 30
    margin, base = plain(tree, x, frozenset(range(40))), plain(tree, x, frozenset())
    assert np.abs(parts.sum(axis=1) + base - margin).max() < 1e-9


def test_drivers_explain_the_served_model(monkeypatch):
    from quaystone.plans import training

    class Stopped(Exception):
        pass

    def trained(rows, params=None):
        assert params is None
        raise Stopped

    monkeypatch.setattr(training, "matrix", lambda spark, sf_dir: None)
    monkeypatch.setattr(training, "labelled", lambda rows: rows)
    monkeypatch.setattr(training.t, "train_gbt", trained)
    for name in ("ml_gbt_predict", "ml_drivers", "ml_importance"):
        with pytest.raises(Stopped):
            getattr(training, name)(None, "")


def test_last_share(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 7) + dt.timedelta(weeks=i // 2), i) for i in range(100)], "week_ending date, i int")
    before, last = t.last_share(df)
    assert before.count() == 80 and last.count() == 20
