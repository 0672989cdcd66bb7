"""The commit log with writers at the same time."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quaystone.models import boosting, store
from quaystone.models import trees as t
from quaystone.sources import commits, lake


def test_many_writers_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    with ThreadPoolExecutor(16) as pool:
        numbers = list(pool.map(lambda i: commits.commit(spark, folder, {"i": i}), range(64)))
    found = commits.entries(spark, folder)
    assert sorted(numbers) == list(range(64)) == [e["number"] for e in found]
    assert sorted(e["i"] for e in found) == list(range(64)) and all(found[n]["i"] == i for i, n in enumerate(numbers))


def test_an_entry_appears_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "log" / "0000000000.json")
    assert commits.put_if_absent(spark, path, "{}") and not commits.put_if_absent(spark, path, "[]")
    assert open(path).read() == "{}" and os.listdir(tmp_path / "log") == ["0000000000.json"]
    (tmp_path / "log" / "_0000000001.json-abc").write_text('{"half": ')  # a writer that died
    assert [e["number"] for e in commits.entries(spark, str(tmp_path / "log"))] == [0]
    assert commits.entries(spark, str(tmp_path / "nothing")) == []


def test_other_file_systems(spark, tmp_path, monkeypatch):
    """The way of file systems with a rename that doesn't replace."""
    monkeypatch.setattr(commits, "_local", lambda path: None)
    folder = f"file://{tmp_path}/log"
    assert [commits.commit(spark, folder, {"i": i}) for i in range(3)] == [0, 1, 2]
    assert not commits.put_if_absent(spark, f"{folder}/0000000001.json", "{}")
    assert [(e["i"], e["number"]) for e in commits.entries(spark, folder)] == [(0, 0), (1, 1), (2, 2)]
    assert commits.entries(spark, f"file://{tmp_path}/none") == []


def test_only_one_of_two_that_exclude_each_other(spark, tmp_path):
    folder = str(tmp_path / "log")
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: commits.commit(spark, folder, {"job": "a"}, unless=lambda log: any(e.get("job") == "a" for e in log)), range(8)))
    assert [n for n in done if n is not None] == [0] and len(commits.entries(spark, folder)) == 1


def test_rows_count_once_committed(spark, tmp_path):
    root = str(tmp_path / "table")
    commits.write_rows(spark.range(5), root)  # nothing names it
    assert commits.read_rows(spark, root, "id long").count() == 0
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: commits.append_rows(spark.range(i * 10, i * 10 + 3), root), range(6)))
    got = commits.read_rows(spark, root, "id long").collect()
    assert sorted(r.id for r in got) == sorted(10 * i + j for i in range(6) for j in range(3)) and {r.commit for r in got} == set(range(6))


def test_run_records_replace_earlier_ones(spark, tmp_path):
    root = str(tmp_path)
    make = lambda status: spark.range(4).select(F.col("id").alias("run_id"), F.lit("news").alias("source"), F.lit("2001-01-01").alias("started_at"), F.lit(None).alias("finished_at"), F.lit(status).alias("status"), F.lit(0).alias("errors"), F.lit(1).alias("records_stored"))
    lake.record_runs(make("running"), root)
    lake.record_runs(make("success").filter("run_id < 3"), root)
    assert {r.run_id: r.status for r in lake.recorded_runs(spark, root).collect()} == {0: "success", 1: "success", 2: "success", 3: "running"}


def test_models_saved_at_the_same_time(spark, tmp_path):
    root = str(tmp_path / "models")
    leaf = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [0.1], "cover": [1.0]}
    model = boosting.Model([{k: __import__("numpy").array(v) for k, v in leaf.items()}], t.FEATURES)
    forest = spark.createDataFrame([(0, 0, -1, 0.0, -1, -1, 5)], t.FOREST)
    put = lambda i: store.save(spark, root, model, forest, (0.0, 1.0), None, {"tuned_cv_pr_auc": i / 10, "n_train_rows": i, "n_features": 33})
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(put, range(8)))
    assert len(set(names)) == 8 and {r.version for r in store.versions(spark, root).collect()} == set(names)
    log = [json.loads(p.read_text()) for p in sorted((tmp_path / "models" / "log").iterdir())]
    best, score = None, -1
    for e in log:
        if e["pr_auc"] > score:
            best, score = e["version"], e["pr_auc"]
    assert store.champion(spark, root) == best
    with pytest.raises(ValueError):
        store.promote(spark, root, "v0")
