"""Boosting against a plain booster, and both ways of training against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.models import boosting as b
from quaystone.models.boosting import DEFAULTS, EVERY, Spec


def plain(x, y, keys, spec):
    """Trees as nested tuples (column, cut, left, right) or leaf values, node by node with sums over lists of rows."""
    p, n = spec.params, len(y)
    cuts = [sorted(set(np.quantile(x[:, j], [i / b.BINS for i in range(1, b.BINS)], method="inverted_cdf"))) for j in range(x.shape[1])]
    margin, out = [0.0] * n, []
    shrunk = lambda g: math.copysign(max(abs(g) - p["reg_alpha"], 0), g)
    for tree in range(p["n_estimators"]):
        u, columns = b.drawn(keys, tree), b.columns_of(tree, p["colsample_bytree"], x.shape[1])
        g, h = b.gradients(np.array(margin), y, spec.weight)

        def total(rows, z):
            return sum(int(z[r]) for r in rows) / b.SCALE

        def grow(rows, depth):
            best = (b.LEAST_GAIN, None)
            score = lambda some: shrunk(total(some, g)) ** 2 / (total(some, h) + p["reg_lambda"])
            for j in columns if depth else []:
                for cut in cuts[j]:
                    left, right = [r for r in rows if x[r, j] <= cut], [r for r in rows if x[r, j] > cut]
                    if left and right and min(total(left, h), total(right, h)) >= p["min_child_weight"]:
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, cut, left, right))
            if best[1] is None:
                return -shrunk(total(rows, g)) / (total(rows, h) + p["reg_lambda"]) * p["learning_rate"]
            j, cut, left, right = best[1]
            return (int(j), float(cut), grow(left, depth - 1), grow(right, depth - 1))

        t = grow([r for r in range(n) if u[r] < p["subsample"]], p["max_depth"])
        out.append(t)
        for r in range(n):
            at = t
            while isinstance(at, tuple):
                at = at[2] if x[r, at[0]] <= at[1] else at[3]
            margin[r] += at
    return out


def nested(t, node=0):
    if t["feature"][node] < 0:
        return float(t["value"][node])
    return (int(t["feature"][node]), float(t["threshold"][node]), nested(t, t["left"][node]), nested(t, t["right"][node]))


def close(a, c):
    if isinstance(a, tuple) != isinstance(c, tuple):
        return False
    return (a[:2] == c[:2] and close(a[2], c[2]) and close(a[3], c[3])) if isinstance(a, tuple) else abs(a - c) < 1e-9


def table(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.uniform(size=n), np.zeros(n)])
    y = (x[:, 0] + 0.6 * x[:, 1] + rng.normal(size=n) > 1).astype(int)
    rows = [(i, *map(float, r), int(v), [0, 1] if i < n // 2 else [1] if i < 3 * n // 4 else [], [0] if n // 2 <= i < 3 * n // 4 else [1] if i >= 3 * n // 4 else []) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, trains array<int>, tests array<int>").repartition(3), x, y


COLUMNS = ["a", "b", "c", "d"]
SPECS = [
    {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0},
    {"n_estimators": 4, "max_depth": 2, "subsample": 0.7, "colsample_bytree": 0.5, "min_child_weight": 4, "reg_alpha": 0.7, "reg_lambda": 1e-8},
    {"n_estimators": 2, "max_depth": 5, "min_child_weight": 2, "reg_alpha": 1e-8, "reg_lambda": 0.3},
]


@pytest.mark.parametrize("params", SPECS)
def test_against_a_plain_booster(spark, params):
    df, x, y = table(spark)
    spec = Spec(0, EVERY, 1.7, DEFAULTS | params)
    model = b.model_of(b.train(df, [spec], COLUMNS, ["id"], "y"), COLUMNS)
    keys = np.array([r[0] for r in df.select(F.xxhash64("id"), "id").orderBy("id").collect()], np.int64)
    want = plain(x, y, keys, spec)
    assert len(model.trees) == len(want) and all(close(nested(t), w) for t, w in zip(model.trees, want, strict=True))
    assert any(isinstance(w, tuple) for w in want)


def test_both_ways_and_any_partitions_give_the_same_trees(spark, monkeypatch):
    df, _, _ = table(spark)
    specs = [Spec(i * 10 + fold, fold, 2.0 + fold, DEFAULTS | p) for i, p in enumerate(SPECS) for fold in (0, 1)]
    get = lambda frame: sorted(map(tuple, b.train(frame, specs, COLUMNS, ["id"], "y", F.col("trains")).collect()))
    score = lambda frame: sorted(map(tuple, b.cross_validate(frame, specs, COLUMNS, ["id"], "y", F.col("trains"), F.col("tests")).collect()))
    nodes, scores = get(df), score(df)
    assert {(r[0], r[1]) for r in scores} == {(s.model, s.fold) for s in specs} and len(scores) == 3 * 80
    monkeypatch.setattr(b, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(b, "STORED_ROUNDS", 2)
    assert get(df.repartition(5)) == nodes and score(df.repartition(2)) == scores
    p = {(r[0], r[2]): r[4] for r in scores}
    model = b.model_of(spark.createDataFrame(nodes, b.NODES), COLUMNS, specs[3].model)
    for r in df.filter("id >= 120").withColumn("p", b.probability(spark, model)).collect():
        assert abs(p[specs[3].model, r.id] - r.p) < 1e-12


def test_jobs_do_not_grow_with_models(spark, monkeypatch):
    df, _, _ = table(spark, 60)
    monkeypatch.setattr(b, "BROADCAST_BYTES", 0)

    def jobs(n):
        spark.sparkContext.setJobGroup(f"models-{n}", "")
        b.train(df, [Spec(i, EVERY, 1.0, DEFAULTS | {"n_estimators": 2, "max_depth": 2}) for i in range(n)], COLUMNS, ["id"], "y")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"models-{n}"))

    assert abs(jobs(1) - jobs(9)) <= 2  # adaptive plans vary by a job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_learns_and_edge_cases(spark):
    df, x, y = table(spark, 600, 3)
    model = b.model_of(b.train(df.filter("id < 400"), [Spec(0, EVERY, 1.0, DEFAULTS | {"n_estimators": 40})], COLUMNS, ["id"], "y"), COLUMNS)
    p = 1 / (1 + np.exp(-b.margin(model, x[400:])))
    pos, neg = p[y[400:] == 1], p[y[400:] == 0]
    assert np.mean(pos[:, None] > neg[None, :]) > 0.8
    one = df.filter("y = 1")
    flat = b.model_of(b.train(one, [Spec(0, EVERY, 1.0, DEFAULTS | {"n_estimators": 2})], COLUMNS, ["id"], "y"), COLUMNS)
    assert len(flat.trees) == 2 and (b.margin(flat, x[:5]) > 0).all()
    assert b.train(df, [], COLUMNS, ["id"], "y").count() == 0
