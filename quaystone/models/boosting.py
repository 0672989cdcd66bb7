"""Second-order boosting of binary trees on histograms, all folds and settings at once.

Features are cut into quantile bins once. Each tree draws its rows by a hash of their keys and its columns by its number, both the
same for all models, and grows level by level: gradients are summed by (model, node, feature, bin), and a node splits where the
regularised gain is largest. Gradients are rounded to 1/SCALE and summed as whole numbers, so sums don't depend on how rows are
dealt, and both ways below give the same trees to the last bit.

* A binned table of at most BROADCAST_BYTES is broadcast, and every model is a task: one job trains all of them.
* A larger one stays in partitions, which hold the margins of all models. A level is one job for all models: partial sums in
  tasks, one grouped sum, the best split of each (model, node) in a task, and what reaches the driver is a row a node. Margins are
  written every STORED_ROUNDS trees; in between they follow from the trees since.

Either way the number of jobs doesn't depend on the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.sources.lake import scratch

BINS, SCALE = 64, 1 << 24
#: Size of a binned table up to which it is broadcast, and bytes a row besides its bins: key, label and folds.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 24
#: Trees after which the margins of a table in partitions are written.
STORED_ROUNDS = 10
#: Least gain of a split.
LEAST_GAIN = 1e-6
#: Parameters of a model, by their usual names; a search sets all eight.
DEFAULTS = {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 1, "reg_alpha": 0.0, "reg_lambda": 1.0}
SEED = 42
NODES = "model int, tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
#: The fold that all rows train.
EVERY = -1


class Spec(NamedTuple):
    """One model: its number, the fold whose training rows it sees (EVERY: all), how much a positive row weighs, parameters."""

    model: int
    fold: int
    weight: float
    params: dict


class Model(NamedTuple):
    """Trees as arrays of nodes: feature (-1 at a leaf), threshold (left: x <= threshold), left, right, value, cover."""

    trees: list[dict[str, np.ndarray]]
    columns: list[str]


# Trees ----------------------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(keys: np.ndarray, tree: int, seed: int = SEED) -> np.ndarray:
    """A number from 0 to 1 for each row's key and a tree; a model takes the rows under its share."""
    salt = _mixed(np.array([(seed << 32) + tree + 1], np.uint64))[0]
    return (_mixed(keys.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / (1 << 53)


def columns_of(tree: int, share: float, n: int, seed: int = SEED) -> np.ndarray:
    order = np.random.default_rng([seed, tree]).permutation(n)
    return np.sort(order[: max(1, int(share * n))])


def gradients(margin: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, times SCALE and rounded."""
    p, w = 1 / (1 + np.exp(-margin)), np.where(y > 0, weight, 1.0) * SCALE
    return np.rint((p - y) * w), np.rint(p * (1 - p) * w)


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf_value(g, h, params: dict):
    g, h = np.asarray(g) / SCALE, np.asarray(h) / SCALE
    return -_shrunk(g, params["reg_alpha"]) / np.maximum(h + params["reg_lambda"], 1e-12) * params["learning_rate"]


def best_splits(g: np.ndarray, h: np.ndarray, params: dict):
    """g, h: (nodes, columns, bins) sums. Per node: column (-1 without a split), bin, and the left side's sums. Ties go to the first."""
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h

    def score(a, b):
        return _shrunk(a / SCALE, params["reg_alpha"]) ** 2 / (b / SCALE + params["reg_lambda"])

    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    least = max(params["min_child_weight"] * SCALE, 1)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -1).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    rows = np.arange(len(g))
    column = np.where(gain[rows, best] > LEAST_GAIN, best // g.shape[2], -1)
    return column, best % g.shape[2], left_g.reshape(len(g), -1)[rows, best], left_h.reshape(len(g), -1)[rows, best]


class Growing:
    """A tree while it grows: node i has the children 2 * i + 1 and 2 * i + 2."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
        self.g, self.h = np.zeros(size), np.zeros(size)
        self.open = np.array([0])  # nodes of the lowest level

    def split(self, nodes: np.ndarray, feature: np.ndarray, at: np.ndarray, left_g: np.ndarray, left_h: np.ndarray) -> None:
        some = feature >= 0
        nodes, feature, at, left_g, left_h = (x[some] for x in (nodes, feature, at, left_g, left_h))
        self.feature[nodes], self.bin[nodes] = feature, at
        for side, g, h in ((1, left_g, left_h), (2, self.g[nodes] - left_g, self.h[nodes] - left_h)):
            self.g[2 * nodes + side], self.h[2 * nodes + side] = g, h
        self.open = np.sort(np.concatenate([2 * nodes + 1, 2 * nodes + 2]))

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row (bins: column by column) ends."""
        node, rows = np.zeros(bins.shape[1], int), np.arange(bins.shape[1])
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            here = node[rows]
            node[rows] = 2 * here + 1 + (bins[self.feature[here], rows] > self.bin[here])
        return node

    def values(self, params: dict) -> np.ndarray:
        return leaf_value(self.g, self.h, params)

    def packed(self, cuts: list[np.ndarray], params: dict) -> dict[str, np.ndarray]:
        """The nodes that are there, numbered in the order of levels."""
        used, number = [0], {}
        for node in used:
            number[node] = len(number)
            if self.feature[node] >= 0:
                used += [2 * node + 1, 2 * node + 2]
        nodes = np.array(used)
        inner = self.feature[nodes] >= 0
        value = self.values(params)[nodes]
        return {
            "feature": self.feature[nodes], "threshold": np.array([cuts[self.feature[n]][self.bin[n]] if i else 0.0 for n, i in zip(used, inner, strict=True)]),
            "left": np.array([number[2 * n + 1] if i else -1 for n, i in zip(used, inner, strict=True)]), "right": np.array([number[2 * n + 2] if i else -1 for n, i in zip(used, inner, strict=True)]),
            "value": np.where(inner, 0.0, value), "cover": self.h[nodes] / SCALE,
        }


def boost(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, spec: Spec) -> list[Growing]:
    """All trees of a model from its training rows. bins: one row a feature."""
    p, margin, out = spec.params, np.zeros(len(y)), []
    for tree in range(p["n_estimators"]):
        rows = np.flatnonzero(drawn(keys, tree) < p["subsample"])
        columns = columns_of(tree, p["colsample_bytree"], len(bins))
        mine = bins[np.ix_(columns, rows)]
        g, h = gradients(margin[rows], y[rows], spec.weight)
        t = Growing(p["max_depth"])
        t.g[0], t.h[0] = g.sum(), h.sum()
        node = np.zeros(len(rows), int)
        for _ in range(p["max_depth"]):
            if not len(t.open):
                break
            place = np.full(len(t.feature), -1)
            place[t.open] = np.arange(len(t.open))
            live = np.flatnonzero(place[node] >= 0)
            at, size = place[node[live]] * BINS, len(t.open) * BINS
            sums = np.empty((2, len(columns), size))
            for j in range(len(columns)):
                cell = at + mine[j, live]
                sums[0, j], sums[1, j] = np.bincount(cell, g[live], size), np.bincount(cell, h[live], size)
            hist = sums.reshape(2, len(columns), len(t.open), BINS).swapaxes(1, 2)
            column, cut, left_g, left_h = best_splits(hist[0], hist[1], p)
            feature = np.where(column >= 0, columns[column], -1)
            t.split(t.open, feature, cut, left_g, left_h)
            live = live[t.feature[node[live]] >= 0]
            here = node[live]
            node[live] = 2 * here + 1 + (bins[t.feature[here], rows[live]] > t.bin[here])
        out.append(t)
        margin += t.values(p)[t.route(bins)]
    return out


# Bins -----------------------------------------------------------------------------------------------------------------------


def quantile_cuts(rows: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """At most BINS - 1 cuts of each column, at its quantiles, in one pass. Bin b holds what is over cut b - 1 and not over cut b."""
    shares = [i / BINS for i in range(1, BINS)]
    one = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(one[str(i)] or [], float)) for i in range(len(columns))]


def binned(rows: DataFrame, columns: list[str], keys: list[str], label: str, trains: Column, tests: Column, cuts: list[np.ndarray]) -> DataFrame:
    """The keys of each row; key, their hash; y; trains and tests, the folds whose rows it is one of; bins, a byte a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for j, cut in enumerate(cuts):
                found[:, j] = np.searchsorted(cut, batch.column(f"__c{j}").to_numpy(zero_copy_only=False))
            blob = pa.Array.from_buffers(pa.binary(len(cuts)), len(found), [None, pa.py_buffer(found)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [blob], [*names, "bins"])

    names = [*keys, "key", "y", "trains", "tests"]
    wanted = rows.select(*keys, F.xxhash64(*keys).alias("key"), F.col(label).cast("double").alias("y"), trains.alias("trains"), tests.alias("tests"), *[F.col(c).cast("double").alias(f"__c{j}") for j, c in enumerate(columns)])
    kinds = ", ".join(f"`{n}` {k}" for n, k in wanted.select(*names).dtypes)
    return wanted.mapInArrow(run, f"{kinds}, bins binary")


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (a row a feature), labels and keys of an Arrow batch or table."""
    raw = batch.column("bins").to_pylist()
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), len(raw[0]) if raw else 0)
    return np.ascontiguousarray(flat.T), batch.column("y").to_numpy(), batch.column("key").to_numpy()


def _of_fold(batch, column: str, fold: int) -> np.ndarray:
    return np.array([fold == EVERY or fold in (f or ()) for f in batch.column(column).to_pylist()], bool)


# Training --------------------------------------------------------------------------------------------------------------------


def _in_tasks(table: DataFrame, specs: list[Spec], out, schema: str) -> DataFrame:
    """A model a task, over the broadcast table; the longest go first. out(spec, its trees, the table): what a task gives."""
    order = sorted(specs, key=lambda s: -s.params["n_estimators"] * s.params["max_depth"])
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((table.toArrow(), order))  # at most BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, listed = shared.value
        for batch in batches:
            for i in batch.column("id").to_pylist():
                trees = boost(*_arrays(whole.filter(pa.array(_of_fold(whole, "trains", listed[i].fold)))), listed[i])
                yield from out(listed[i], trees, whole)

    return spark.range(len(order), numPartitions=max(1, len(order))).mapInArrow(run, schema)


def _nodes(model: int, tree: int, t: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(t["feature"])
    whole = {"model": np.full(n, model), "tree": np.full(n, tree), "node": np.arange(n), **{c: t[c] for c in ("feature", "left", "right")}}
    columns = {**{k: pa.array(v, pa.int32()) for k, v in whole.items()}, **{c: pa.array(t[c], pa.float64()) for c in ("threshold", "value", "cover")}}
    names = [x.split(" ")[0] for x in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def _predicted(spec: Spec, margin: np.ndarray, batch, keys: list[str]) -> pa.RecordBatch:
    """Probabilities of a fold's test rows. batch: these rows."""
    p, n = 1 / (1 + np.exp(-margin)), batch.num_rows
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    columns = [pa.array(np.full(n, x), pa.int32()) for x in (spec.model, spec.fold)] + [flat(batch.column(k)) for k in keys] + [pa.array(batch.column("y").to_numpy().astype(np.int32)), pa.array(p)]
    return pa.RecordBatch.from_arrays(columns, ["model", "fold", *keys, "y", "p"])


def _margins(batch: pa.RecordBatch, bins: np.ndarray, specs: list[Spec], rounds: list[list[Growing | None]]) -> np.ndarray:
    """(models, rows) margins: those stored with the rows and the trees since."""
    out = np.array(batch.column("margins").to_pylist(), float).reshape(batch.num_rows, len(specs)).T.copy()
    for trees in rounds:
        for i, t in enumerate(trees):
            if t is not None:
                out[i] += t.values(specs[i].params)[t.route(bins)]
    return out


def _summed(specs: list[Spec], rounds: list, growing: list[Growing | None], tree: int):
    """Sums of gradients of the open nodes' rows by model, node and cell (column * BINS + bin), batch by batch; cell -1 is the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, y, keys = _arrays(batch)
            margins, u, out = _margins(batch, bins, specs, rounds), drawn(keys, tree), []
            for i, (spec, t) in enumerate(zip(specs, growing, strict=True)):
                if t is None or not len(t.open):
                    continue
                rows = np.flatnonzero((u < spec.params["subsample"]) & _of_fold(batch, "trains", spec.fold))
                node = t.route(bins[:, rows])
                rows, node = rows[np.isin(node, t.open)], node[np.isin(node, t.open)]
                g, h = gradients(margins[i, rows], y[rows], spec.weight)
                columns = columns_of(tree, spec.params["colsample_bytree"], len(bins))
                width = len(bins) * BINS + 1
                for column in (-1, *columns):
                    cells = column * BINS + bins[column, rows] if column >= 0 else np.full(len(rows), -1)
                    pairs, place = np.unique(node * width + cells + 1, return_inverse=True)
                    out.append((np.full(len(pairs), i), pairs // width, pairs % width - 1, np.bincount(place, g, len(pairs)), np.bincount(place, h, len(pairs))))
            if out:
                columns = [np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["model", "node", "cell", "g", "h"])

    return run


def _chosen(specs: list[Spec], tree: int, n_columns: int):
    """The best split of one (model, node), from its summed cells."""

    def run(cells: pa.Table) -> pa.Table:
        model, node = cells.column("model")[0].as_py(), cells.column("node")[0].as_py()
        params = specs[model].params
        columns = columns_of(tree, params["colsample_bytree"], n_columns)
        at, g, h = (cells.column(c).to_numpy() for c in ("cell", "g", "h"))
        hist = np.zeros((2, n_columns * BINS))
        some = at >= 0
        hist[0, at[some]], hist[1, at[some]] = g[some], h[some]
        hist = hist.reshape(2, 1, n_columns, BINS)[:, :, columns]
        column, cut, left_g, left_h = best_splits(hist[0], hist[1], params)
        feature = int(columns[column[0]]) if column[0] >= 0 else -1
        row = (model, node, feature, int(cut[0]), float(left_g[0]), float(left_h[0]), float(g[~some][0]), float(h[~some][0]))
        return pa.table({c: [v] for c, v in zip(("model", "node", "feature", "bin", "left_g", "left_h", "g", "h"), row, strict=True)})

    return run


_SPLIT = "model long, node long, feature long, bin long, left_g double, left_h double, g double, h double"


class _Partitions:
    """All models level by level over the table's partitions."""

    def __init__(self, table: DataFrame, specs: list[Spec], n_columns: int):
        self.spark, self.specs, self.n_columns = table.sparkSession, specs, n_columns
        self.base, self.number, self.rounds = f"{scratch(self.spark)}/boosting", 0, []
        self.schema = table.withColumn("margins", F.array(F.lit(0.0))).schema
        self._keep(table.withColumn("margins", F.array_repeat(F.lit(0.0), len(specs))))

    def _keep(self, df: DataFrame) -> None:
        path = f"{self.base}/margins-{self.number}"
        df.write.mode("overwrite").parquet(path)
        self.state, self.number, self.rounds = self.spark.read.schema(self.schema).parquet(path), self.number + 1, []

    def _updated(self) -> DataFrame:
        specs, rounds = self.specs, self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = _margins(batch, _arrays(batch)[0], specs, rounds).T
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", pa.array(list(margins), pa.list_(pa.float64())))

        return self.state.mapInArrow(run, self.schema)

    def grow(self) -> Iterator[tuple[int, list[Growing | None]]]:
        specs = self.specs
        last = max((s.params["n_estimators"] for s in specs), default=0)
        for tree in range(last):
            growing = [Growing(s.params["max_depth"]) if tree < s.params["n_estimators"] else None for s in specs]
            for level in range(max(s.params["max_depth"] for s in specs)):
                now = [t if t is not None and level < specs[i].params["max_depth"] else None for i, t in enumerate(growing)]
                if not any(t is not None and len(t.open) for t in now):
                    break
                cells = self.state.mapInArrow(_summed(specs, self.rounds, now, tree), "model long, node long, cell long, g long, h long")
                sums = cells.groupBy("model", "node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                found = sums.groupBy("model", "node").applyInArrow(_chosen(specs, tree, self.n_columns), _SPLIT).toArrow().to_pandas()  # a row a node
                for model, mine in found.sort_values(["model", "node"]).groupby("model"):
                    t = growing[model]
                    if level == 0:
                        t.g[0], t.h[0] = mine["g"].iloc[0], mine["h"].iloc[0]
                    t.split(*[mine[c].to_numpy() for c in ("node", "feature", "bin", "left_g", "left_h")])
            yield tree, growing
            self.rounds.append(growing)
            if len(self.rounds) == STORED_ROUNDS:
                self._keep(self._updated())

    def nodes(self, cuts: list[np.ndarray]) -> DataFrame:
        held, path = [], f"{self.base}/nodes"
        self.spark.createDataFrame([], NODES).write.parquet(path)
        for tree, growing in self.grow():
            held += [_nodes(s.model, tree, t.packed(cuts, s.params)) for s, t in zip(self.specs, growing, strict=True) if t is not None]
            if (tree + 1) % 100 == 0:
                self._put(held, path)
                held = []
        self._put(held, path)
        return self.spark.read.schema(NODES).parquet(path)

    def _put(self, held: list[pa.RecordBatch], path: str) -> None:
        if held:
            self.spark.createDataFrame(pa.Table.from_batches(held)).write.mode("append").parquet(path)

    def predictions(self, keys: list[str], schema: str) -> DataFrame:
        for _ in self.grow():
            pass
        specs, rounds = self.specs, self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = _margins(batch, _arrays(batch)[0], specs, rounds)
                for i, spec in enumerate(specs):
                    mine = np.flatnonzero(_of_fold(batch, "tests", spec.fold))
                    if len(mine):
                        yield _predicted(spec, margins[i, mine], batch.take(pa.array(mine)), keys)

        return self.state.mapInArrow(run, schema)


def _prepared(rows: DataFrame, specs: list[Spec], columns: list[str], keys: list[str], label: str, trains: Column | None, tests: Column | None):
    """The binned table, written; whether it is small enough to broadcast; specs with all parameters; cuts."""
    spark, none = rows.sparkSession, F.array().cast("array<int>")
    cuts = quantile_cuts(rows, columns)
    made = binned(rows, columns, keys, label, none if trains is None else trains, none if tests is None else tests, cuts)
    path = f"{scratch(spark)}/binned"
    made.write.parquet(path)
    table = spark.read.schema(made.schema).parquet(path)
    return table, table.count() * (len(columns) + ROW_BYTES) <= BROADCAST_BYTES, [s._replace(params=DEFAULTS | s.params) for s in specs], cuts


def _written(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/boosted"
    df.write.parquet(path)  # read again for every use
    return df.sparkSession.read.schema(df.schema).parquet(path)


def train(rows: DataFrame, specs: list[Spec], columns: list[str], keys: list[str], label: str, trains: Column | None = None) -> DataFrame:
    """Node tables of all models: model, tree, node, feature, threshold, left, right, value, cover.

    rows: features as numbers without nulls, and labels 0 and 1. keys: name a row, for the draws. trains: the array of folds whose
    training rows a row is one of."""
    table, small, specs, cuts = _prepared(rows, specs, columns, keys, label, trains, None)
    if not small:
        return _Partitions(table, specs, len(columns)).nodes(cuts)

    def out(spec: Spec, trees: list[Growing], whole: pa.Table) -> Iterator[pa.RecordBatch]:
        for i, t in enumerate(trees):
            yield _nodes(spec.model, i, t.packed(cuts, spec.params))

    return _written(_in_tasks(table, specs, out, NODES))


def cross_validate(rows: DataFrame, specs: list[Spec], columns: list[str], keys: list[str], label: str, trains: Column, tests: Column) -> DataFrame:
    """Every model trained on its fold's training rows, and its probabilities of the fold's test rows: model, fold, keys, y, p.
    trains, tests: the arrays of folds whose rows a row is one of."""
    table, small, specs, _ = _prepared(rows, specs, columns, keys, label, trains, tests)
    schema = "model int, fold int, " + ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes) + ", y int, p double"
    if not small:
        return _written(_Partitions(table, specs, len(columns)).predictions(keys, schema))

    def out(spec: Spec, trees: list[Growing], whole: pa.Table) -> Iterator[pa.RecordBatch]:
        mine = whole.filter(pa.array(_of_fold(whole, "tests", spec.fold)))
        bins = _arrays(mine)[0]
        margin = np.zeros(mine.num_rows)
        for t in trees:
            margin += t.values(spec.params)[t.route(bins)]
        yield _predicted(spec, margin, mine, keys)

    return _written(_in_tasks(table, specs, out, schema))


# Models ----------------------------------------------------------------------------------------------------------------------


def model_of(nodes: DataFrame, columns: list[str], model: int = 0) -> Model:
    """A model of a node table; its size follows from its parameters, not from the rows."""
    found = nodes.filter(F.col("model") == model).toPandas().sort_values(["tree", "node"])
    ends = np.flatnonzero(np.append(found["tree"].to_numpy()[1:] != found["tree"].to_numpy()[:-1], True)) + 1 if len(found) else []
    parts = {c: np.split(found[c].to_numpy(), ends[:-1]) for c in ("feature", "threshold", "left", "right", "value", "cover")}
    return Model([{c: parts[c][i] for c in parts} for i in range(len(ends))], columns)


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_batches([_nodes(0, i, t) for i, t in enumerate(model.trees)])).select(*[F.col(n).cast(k).alias(n) for n, k in (x.split(" ") for x in NODES.split(", "))])


def margin(model: Model, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for t in model.trees:
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows):
            rows = rows[t["feature"][node[rows]] >= 0]
            here = node[rows]
            node[rows] = np.where(x[rows, t["feature"][here]] <= t["threshold"][here], t["left"][here], t["right"][here])
        out += t["value"][node]
    return out


def probability(spark: SparkSession, model: Model) -> Column:
    """The model's probability of each row, from its columns."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p(*values: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-margin(shared.value, np.column_stack([v.to_numpy(float) for v in values])))))

    return p(*[F.col(c).cast("double") for c in model.columns])
