"""Boosted trees, calibration, isolation forest and tree attributions over the gold table.

Boosted trees are those of models/boosting; isolation trees are built one group a tree; scoring broadcasts tables of tree nodes,
whose number depends on the number and depth of trees and not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.models import boosting
from quaystone.models.boosting import Model, Spec
from quaystone.models.metrics import average_precision, precision_at_k, roc_auc
from quaystone.operators.quantiles import percentiles
from quaystone.registry import ANOMALY_COLUMNS, MODEL_COLUMNS

FEATURES = [*MODEL_COLUMNS, "port_id_enc"]
ROW_KEYS = ["port_id", "week_ending"]
FOREST = "tree int, node int, feature int, split double, left int, right int, size int"
#: The usual parameters, and trees, rows a tree and share of outliers of the isolation forest.
DEFAULTS = dict(boosting.DEFAULTS)
TREES, SAMPLE, CONTAMINATION = 200, 256, 0.05
#: Trials of the search.
TRIALS = 30
#: Fewest labelled rows to train at all, to search parameters, of a fold's training side, and to calibrate.
LEAST_ROWS, LEAST_SEARCH, LEAST_TRAIN, LEAST_CALIBRATION = 10, 80, 20, 20
LABEL = "is_disruption_week"
LARGEST = np.finfo(float).max


def class_weight(pos: int | None, n: int) -> float:
    """How much more a positive row weighs than a negative one: negatives by positives, 1 without positives."""
    return float((n - pos) / pos) if pos else 1.0


def train_gbt(labelled: DataFrame, params: dict | None = None, columns: list[str] = FEATURES, keys: list[str] = ROW_KEYS) -> Model:
    """labelled (keys, columns, is_disruption_week): boosted trees with the rarer class weighted up. A ValueError with under
    LEAST_ROWS rows."""
    pos, n = labelled.agg(F.sum(LABEL), F.count("*")).first()
    if n < LEAST_ROWS:
        raise ValueError(f"too few labelled rows to train: {n}")
    spec = Spec(0, boosting.EVERY, class_weight(pos, n), DEFAULTS | (params or {}))
    return boosting.model_of(boosting.train(labelled, [spec], columns, keys, LABEL), columns)


def predict(model: Model, rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", boosting.probability(rows.sparkSession, model))


def with_folds(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """rows with trains and tests: the folds whose training and test weeks a row's week is one of."""
    of = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.col("fold"))))
    weeks = splits.groupBy("week_ending").agg(of("train").alias("trains"), of("test").alias("tests"))
    none = F.array().cast("array<int>")
    return rows.join(weeks, "week_ending", "left").withColumns({c: F.coalesce(c, none) for c in ("trains", "tests")})


def usable_folds(folded: DataFrame, least: int = LEAST_TRAIN) -> dict[int, float]:
    """The weight of a positive row in each fold with at least `least` training rows and test rows of both classes. One row a fold."""
    each = lambda c: folded.select(F.explode(c).alias("fold"), F.col(LABEL).alias("y"))
    train = each("trains").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    test = each("tests").groupBy("fold").agg(F.count_distinct("y").alias("classes"))
    found = train.join(test, "fold").filter((F.col("n") >= least) & (F.col("classes") == 2)).collect()
    return {r["fold"]: class_weight(r["pos"], r["n"]) for r in sorted(found)}


def cross_validated(rows: DataFrame, splits: DataFrame, grid: list[dict | None], columns: list[str] = FEATURES, keys: list[str] = ROW_KEYS, least: int = LEAST_TRAIN) -> tuple[DataFrame, list[int]] | None:
    """Probabilities of the test rows by every setting of the grid in every usable fold: trial, fold, keys, y, p; and the folds. All
    are trained at once. None without a fold."""
    folded = with_folds(rows, splits)
    folds = usable_folds(folded, least)
    if not folds or not grid:
        return None
    pairs = [(i, fold) for i in range(len(grid)) for fold in folds]
    specs = [Spec(n, fold, folds[fold], DEFAULTS | (grid[i] or {})) for n, (i, fold) in enumerate(pairs)]
    found = boosting.cross_validate(folded, specs, columns, keys, LABEL, F.col("trains"), F.col("tests"))
    return found.withColumn("trial", F.floor(F.col("model") / len(folds)).cast("int")), list(folds)


REPORT = "fold int, n_test long, positive_share double, test_start date, test_end date, n_train long, train_start date, train_end date, pr_auc double, roc_auc double, precision_at_k double"


def fold_report(rows: DataFrame, splits: DataFrame, params: dict | None = None, k: int = 10, least: int = LEAST_TRAIN, columns: list[str] = FEATURES) -> DataFrame:
    """One row a fold, in the order of time: sizes, dates, share of positives, PR-AUC, ROC-AUC, precision at k. A fold with under
    `least` training rows or one class of test rows is left out."""
    found = cross_validated(rows, splits, [params], columns, least=least)
    return report_of(rows, splits, *found, k=k) if found else rows.sparkSession.createDataFrame([], REPORT)


def report_of(rows: DataFrame, splits: DataFrame, scored: DataFrame, folds: list[int], trial: int = 0, k: int = 10) -> DataFrame:
    """The report of one trial of cross_validated()."""
    scored = scored.filter(F.col("trial") == trial)
    size = scored.groupBy("fold").agg(F.count("*").alias("n_test"), F.avg("y").alias("positive_share"), F.min("week_ending").alias("test_start"), F.max("week_ending").alias("test_end"))
    train = with_folds(rows, splits).select(F.explode("trains").alias("fold"), "week_ending").filter(F.col("fold").isin(folds))
    train = train.groupBy("fold").agg(F.count("*").alias("n_train"), F.min("week_ending").alias("train_start"), F.max("week_ending").alias("train_end"))
    out = size.join(train, "fold").join(average_precision(scored, ["fold"]), "fold").join(roc_auc(scored, ["fold"]), "fold")
    return out.join(precision_at_k(scored, ["fold"], k, "port_id"), "fold").orderBy("fold")


def cv_score(report: DataFrame) -> DataFrame:
    """Mean PR-AUC and ROC-AUC of a fold report, 0 without folds."""
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return report.agg(zero("pr_auc").alias("cv_pr_auc"), zero("roc_auc").alias("cv_roc_auc"), F.count("*").alias("folds"))


def settings(trials: int = TRIALS, seed: int = 42) -> list[dict]:
    """Seeded draws of all eight parameters from their ranges."""
    rng = np.random.default_rng(seed)
    log = lambda a, b: float(np.exp(rng.uniform(np.log(a), np.log(b))))
    return [
        {
            "n_estimators": int(rng.integers(50, 401)), "max_depth": int(rng.integers(3, 9)), "learning_rate": log(0.01, 0.3), "subsample": float(rng.uniform(0.6, 1.0)),
            "colsample_bytree": float(rng.uniform(0.5, 1.0)), "min_child_weight": int(rng.integers(1, 11)), "reg_alpha": log(1e-8, 1.0), "reg_lambda": log(1e-8, 1.0),
        }
        for _ in range(trials)
    ]


def trial_scores(scored: DataFrame) -> list[tuple[int, float, int]]:
    """Trial, mean PR-AUC over the folds and number of folds of cross_validated(). One row a trial."""
    means = average_precision(scored, ["trial", "fold"]).groupBy("trial").agg(F.avg("pr_auc").alias("mean"), F.count("*").alias("folds"))
    return sorted((r["trial"], r["mean"], r["folds"]) for r in means.collect())


def search(rows: DataFrame, splits: DataFrame, grid: list[dict], columns: list[str] = FEATURES) -> DataFrame:
    """trial, params, mean_pr_auc and folds of each setting of the grid; nothing without a fold or with under LEAST_SEARCH rows."""
    found = cross_validated(rows, splits, grid, columns) if grid and rows.count() >= LEAST_SEARCH else None
    out = [(i, str(sorted(grid[i].items())), mean, n) for i, mean, n in trial_scores(found[0])] if found else []
    return rows.sparkSession.createDataFrame(out, "trial int, params string, mean_pr_auc double, folds long")


def last_share(rows: DataFrame, share: float = 0.2, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the week that begins the last share of rows (at least `least` rows)."""
    weeks = rows.groupBy("week_ending").count().orderBy(F.desc("week_ending")).collect()  # one row a week
    total, seen, cut = sum(w["count"] for w in weeks), 0, None
    for w in weeks:
        seen, cut = seen + w["count"], w["week_ending"]
        if seen >= max(least, share * total):
            break
    if cut is None:
        return rows, rows.limit(0)
    return rows.filter(F.col("week_ending") < F.lit(cut)), rows.filter(F.col("week_ending") >= F.lit(cut))


def fit_calibration(scored: DataFrame, method: str = "sigmoid") -> dict | None:
    """A logistic curve over p, or an isotonic one, from scored rows (p, y). None with under LEAST_CALIBRATION rows or one class."""
    n, classes = scored.agg(F.count("*"), F.count_distinct("y")).first()
    if n < LEAST_CALIBRATION or classes < 2:
        return None
    rows = scored.select("p", F.col("y").cast("double").alias("label"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="p").fit(rows)
        return {"method": method, "x": [float(v) for v in model.boundaries], "y": [float(v) for v in model.predictions]}
    model = LogisticRegression(featuresCol="px", maxIter=50).fit(VectorAssembler(inputCols=["p"], outputCol="px").transform(rows))
    return {"method": method, "x": [float(model.coefficients[0])], "y": [float(model.intercept)]}


def calibrated(p: Column, fitted: dict | None) -> Column:
    """p on the fitted curve; p itself without one."""
    if fitted is None:
        return p
    if fitted["method"] == "sigmoid":
        return 1 / (1 + F.exp(-(F.lit(fitted["x"][0]) * p + F.lit(fitted["y"][0]))))
    x, y = np.array(fitted["x"]), np.clip(fitted["y"], 0, 1)

    @F.pandas_udf("double")
    def curve(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v, x, y))

    return curve(p)


def calibrate(scored: DataFrame, method: str = "sigmoid") -> DataFrame:
    """scored (p, y, ...) with calibrated: by a logistic curve over p, or by isotonic regression; p itself where there is too little to fit."""
    return scored.withColumn("calibrated", calibrated(F.col("p"), fit_calibration(scored, method)))


# Isolation forest (Liu, Ting and Zhou, ICDM 2008) ----------------------------------------------------------------------


def _cut(low: float, high: float, share: float) -> float:
    """A number over low and up to high, so that a split there leaves rows on both sides, even if no double lies between the two."""
    with np.errstate(over="ignore"):
        span = high - low
    at = low + span * share if np.isfinite(span) else low * (1 - share) + high * share
    return float(min(max(at, np.nextafter(low, high)), high))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (id, feature, split, left, right, size); feature -1 at a leaf."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        able = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(able):
            nodes[me] = (me, -1, 0.0, -1, -1, len(rows))
            return me
        f = int(rng.choice(able))
        split = _cut(low[f], high[f], rng.random())
        side = x[rows, f] < split
        left = grow(rows[side], depth + 1)
        right = grow(rows[~side], depth + 1)
        nodes[me] = (me, f, split, left, right, len(rows))
        return me

    grow(np.arange(len(x)), 0)
    return nodes


def _usual_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _drawn(filled: DataFrame, n: int, trees: int, sample: int) -> DataFrame:
    """Rows with __key by tree: about four samples' worth each, by hashes of the rows' keys."""
    if n > 4 * sample * trees:
        # Enough rows for trees to have parts of their own: a row is in one at most.
        part = F.pmod(F.xxhash64(F.lit(1), "__key"), F.lit(n // (4 * sample)))
        return filled.withColumn("tree", part.cast("int")).filter(F.col("tree") < trees)
    share = int(min(1.0, 4 * sample / n) * (1 << 30))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(t, "__key"), F.lit(1 << 30)) < share)
    return filled.withColumn("tree", F.explode(mine))


def fit_forest(rows: DataFrame, columns: list[str] = ANOMALY_COLUMNS, trees: int = TREES, sample: int = SAMPLE, keys: list[str] = ROW_KEYS) -> DataFrame:
    """Node table of the forest: tree, node, feature, split, left, right, size. Nulls and NaN are zeros, infinities the largest doubles.

    Each tree takes the `sample` rows whose keys have the smallest hashes for it (all, if there are fewer), whatever the rows'
    values; keys identify a row. A tree is built from those rows alone.
    """
    filled = rows.select(F.xxhash64(*keys).alias("__key"), *[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    n = max(1, filled.count())
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(2), "tree", "__key"), "__key"))
    picked = _drawn(filled, n, trees, sample).withColumn("__rank", rank).filter(F.col("__rank") <= sample)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__rank", kind="stable")
        tree = int(pdf["tree"].iloc[0])
        x = np.clip(pdf[columns].to_numpy(float), -LARGEST, LARGEST)
        nodes = _grow(x, np.random.default_rng(tree), int(np.ceil(np.log2(max(2, len(pdf))))))
        return pd.DataFrame([(tree, *x) for x in nodes], columns=["tree", "node", "feature", "split", "left", "right", "size"])

    return picked.groupBy("tree").applyInPandas(build, FOREST)


def _raw_score(rows: DataFrame, forest: DataFrame, columns: list[str]) -> Column | None:
    """Score of the isolation forest, from the mean path lengths: higher is odder. None for a forest without trees."""
    nodes = forest.orderBy("tree", "node").toPandas()  # at most trees * 2 * sample rows
    if nodes.empty:
        return None
    tables = []
    for _, t in nodes.groupby("tree"):
        tables.append({c: t[c].to_numpy() for c in ("feature", "split", "left", "right", "size")})
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("double")
    def raw(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.fillna(0.0).to_numpy(float) for v in values])
        total = np.zeros(len(x))
        for t in shared.value:
            at, depth = np.zeros(len(x), int), np.zeros(len(x))
            while True:
                inner = np.flatnonzero(t["feature"][at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                left = x[inner, t["feature"][here]] < t["split"][here]
                at[inner] = np.where(left, t["left"][here], t["right"][here])
                depth[inner] += 1
            total += depth + _usual_path(t["size"][at])
        size = max(2, int(shared.value[0]["size"][0]))
        return pd.Series(2 ** -(total / len(shared.value) / float(_usual_path(size))))

    return raw(*[F.col(c).cast("double") for c in columns])


def forest_bounds(rows: DataFrame, forest: DataFrame, columns: list[str] = ANOMALY_COLUMNS) -> tuple[float, float]:
    """Least and largest raw score of the training rows, to which scores are scaled."""
    raw = _raw_score(rows, forest, columns)
    low, high = (None, None) if raw is None else rows.select(raw.alias("r")).agg(F.min("r"), F.max("r")).first()
    return (0.0, 0.0) if low is None else (float(low), float(high))


def forest_score(rows: DataFrame, forest: DataFrame, columns: list[str] = ANOMALY_COLUMNS, bounds: tuple[float, float] | None = None) -> DataFrame:
    """rows with anomaly_score from 0 (usual) to 1, scaled to the range of the training rows (these rows, if no bounds are given)."""
    low, high = bounds or forest_bounds(rows, forest, columns)
    raw = _raw_score(rows, forest, columns)
    span = high - low
    if raw is None or span < 1e-9:
        return rows.withColumn("anomaly_score", F.lit(0.0))
    return rows.withColumn("anomaly_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / span)))


def with_outliers(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """scored (anomaly_score, ...) with is_outlier: the share of `contamination` of all rows with the highest scores."""
    cut = percentiles(scored, "anomaly_score", [1 - contamination])[0]
    return scored.withColumn("is_outlier", F.col("anomaly_score") > F.lit(cut))


# Tree attributions (path-dependent Shapley values, Lundberg et al.) -----------------------------------------------------


def node_tables(model: Model) -> list[tuple[float, dict]]:
    """Weight and nodes of each tree: feature, threshold, left, right, value, cover."""
    return [(1.0, t) for t in model.trees]


def _expected(t: dict, x: np.ndarray, known: frozenset, node: int = 0) -> np.ndarray:
    """Tree output when only the features in `known` are given; the others follow the training rows."""
    f = t["feature"][node]
    if f < 0:
        return np.full(len(x), t["value"][node])
    a, b = t["left"][node], t["right"][node]
    low, high = _expected(t, x, known, a), _expected(t, x, known, b)
    if f in known:
        return np.where(x[:, f] <= t["threshold"][node], low, high)
    return (t["cover"][a] * low + t["cover"][b] * high) / t["cover"][node]


def _leaves(t: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Value and path of each leaf: feature, bounds that lead to it (low < x <= high), share of the cover; a feature once."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(t["feature"][node])
        if f < 0:
            out.append((float(t["value"][node]), [(k, *v) for k, v in path.items()]))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut = float(t["threshold"][node])
        for child, bounds in ((t["left"][node], (low, min(high, cut))), (t["right"][node], (max(low, cut), high))):
            todo.append((int(child), path | {f: (*bounds, share * float(t["cover"][child] / t["cover"][node]))}))
    return out


def attributions(x: np.ndarray, trees: list[tuple[float, dict]]) -> np.ndarray:
    """Exact path-dependent Shapley values of the margin, leaf by leaf: what a leaf gives to the sets of k of its path's features
    is a coefficient of the product of (share + fits * y) over them, and dividing by one factor takes that feature out of the
    sets. The work is leaves times depth squared a tree."""
    from math import factorial

    out = np.zeros_like(x)
    for weight, t in trees:
        for value, path in _leaves(t):
            n = len(path)
            if not n:
                continue
            columns, low, high, z = (np.array(c) for c in zip(*path, strict=True))
            fits = (x[:, columns] > low) & (x[:, columns] <= high)
            whole = np.zeros((len(x), n + 1))
            whole[:, 0] = 1
            for i in range(n):
                whole[:, 1:] = whole[:, 1:] * z[i] + whole[:, :-1] * fits[:, i, None]
                whole[:, 0] *= z[i]
            total, above = np.zeros(fits.shape), np.zeros(fits.shape)
            for k in range(n - 1, -1, -1):  # quotients by all factors, from the highest coefficient down
                above = np.where(fits, whole[:, k + 1, None] - z * above, whole[:, k, None] / np.where(z > 0, z, 1))
                total += factorial(k) * factorial(n - 1 - k) / factorial(n) * above
            out[:, columns] += weight * value * (fits - z) * total
    return out


def importance(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean absolute attribution of each feature over all rows, the largest first: feature, mean_impact, n."""
    shared = rows.sparkSession.sparkContext.broadcast(node_tables(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = np.abs(attributions(pdf[columns].to_numpy(float), shared.value)).sum(axis=0)
            yield pd.DataFrame({"feature": columns, "total": total, "n": len(pdf)})

    parts = rows.select(*columns).mapInPandas(run, "feature string, total double, n long")
    out = parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean_impact"), F.sum("n").alias("n"))
    return out.orderBy(F.desc("mean_impact"), "feature")


def drivers(model, rows: DataFrame, columns: list[str], keys: list[str], top: int = 5) -> DataFrame:
    """keys, margin, base and the `top` features by size of their part: drivers (feature, value, impact, direction)."""
    trees = node_tables(model)
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    base = float(sum(w * _expected(t, np.zeros((1, len(columns))), frozenset())[0] for w, t in trees))
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            parts = attributions(x, shared.value)
            margin = sum(w * _expected(t, x, frozenset(int(f) for f in t["feature"] if f >= 0)) for w, t in shared.value)
            first = np.argsort(-np.abs(parts), axis=1, kind="stable")[:, :top]
            listed = [[{"feature": columns[j], "value": float(x[i, j]), "impact": float(parts[i, j]), "direction": "increases_risk" if parts[i, j] > 0 else "decreases_risk"} for j in row] for i, row in enumerate(first)]
            yield pdf[keys].assign(margin=margin, base=base, total_impact=parts.sum(axis=1), drivers=listed)

    schema = f"{kinds}, margin double, base double, total_impact double, drivers array<struct<feature:string, value:double, impact:double, direction:string>>"
    return rows.select(*keys, *columns).mapInPandas(run, schema)
