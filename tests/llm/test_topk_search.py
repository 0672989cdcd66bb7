import math
import random

import numpy as np
from pyspark.sql import functions as F

from quaystone.llm.topk_search import top_k


def brute(rows, k=20):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[i] = min(known.get(i, v), v)
    known = {i: [math.floor(64 * x) for x in v] for i, v in known.items()}
    out = []
    for q, v in known.items():
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known.items() if i != q)
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **blocks):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, **blocks).collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)]  # many ties
    rows += [(20, rows[20][1]), (1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1.0]), (1020, [2.0, 1.0]), (None, [1.0] * 6)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, rows_per_block=50, queries_per_block=4) == brute(rows)


def test_few_rows_and_large_components(spark):
    rows = [(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [1e9, 1e9]), (20, [3e9, 1e9])]
    got = run(spark, rows)
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows)] or {g[0] for g in got} == {0, 20}
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect())
    m = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    ids = np.array([i for i, _ in rows])
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = m @ m[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:20]
        want += [(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)
