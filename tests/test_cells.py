"""Joins over cells of the sphere against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators import cells, geo
from quaystone.registry import ports

R = 6371.0


def km(a, b):
    """Distances of all pairs (lat, lon)."""
    a, b = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((a[..., 0] - b[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((a[..., 1] - b[..., 1]) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(h, 1)))


def places(rng, n):
    """All over the sphere, crowded at the poles and at the date line."""
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[: n // 6], lon[n // 6 : n // 3] = rng.choice([89.9, -89.95, 90.0], n // 6), rng.choice([179.99, -179.99, 180.0], n // 3 - n // 6)
    return np.column_stack([lat, lon])


def frames(spark, events, registry):
    e = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(len(events)), "lat": events[:, 0], "lon": events[:, 1], "ord_": 1}))
    p = spark.createDataFrame(pd.DataFrame({"port_id": [f"p{i}" for i in range(len(registry))], "ord": np.arange(len(registry)), "lat": registry[:, 0], "lon": registry[:, 1]}))
    return e.union(spark.createDataFrame([(-1, None, 1.0, 1), (-2, 1.0, None, 1)], e.schema)), p


@pytest.mark.parametrize("radius", [5.0, 300.0, 4000.0, 25_000.0])
def test_radius_join(spark, radius):
    rng = np.random.default_rng(1)
    events, registry = places(rng, 300), places(rng, 200)
    e, p = frames(spark, events, registry)
    got = {(r.event_id, r.port_id): r.distance_km for r in cells.within(e, p, radius).collect()}
    d = km(events, registry)
    want = {(int(i), f"p{j}"): d[i, j] for i, j in zip(*np.nonzero(d <= radius), strict=True)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got) and want


@pytest.mark.parametrize("limit", [None, 800.0])
def test_nearest_with_ties(spark, limit):
    rng = np.random.default_rng(2)
    events, registry = places(rng, 300), places(rng, 40)
    registry[30:] = registry[:10]  # the first of equal ones wins
    e, p = frames(spark, events, registry)
    got = {r.event_id: (r.port_id, r.distance_km) for r in cells.nearest(e, p, limit).collect()}
    d = km(events, registry)
    want = {i: int(d[i].argmin()) for i in range(300) if limit is None or d[i].min() <= limit}
    assert set(got) == set(want)
    # Distances to one pole place differ in the last bit by longitude, hence the tolerance.
    assert all(abs(got[i][1] - d[i, j]) < 1e-6 and (got[i][0] == f"p{j}" or abs(d[i, int(got[i][0][1:])] - d[i, j]) < 1e-9) for i, j in want.items())


def test_a_large_registry(spark):
    """100,000 ports: no nested loop in the plan, the result of all pairs."""
    rng = np.random.default_rng(3)
    events, registry = places(rng, 2000), places(rng, 100_000)
    e, p = frames(spark, events, registry)
    met = cells.within(e, p, 60.0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.event_id: r for r in cells.nearest(e, p, 200.0, first_km=20.0).collect()}
    for at in range(0, 2000, 200):
        d = km(events[at : at + 200], registry)
        for i in range(200):
            j = int(d[i].argmin())
            assert abs(got[at + i].distance_km - d[i, j]) < 1e-6 and d[i, int(got[at + i].port_id[1:])] - d[i, j] < 1e-6
    assert {(r.event_id, r.port_id) for r in met.filter("event_id < 200").collect()} == {(int(i), f"p{j}") for i, j in zip(*np.nonzero(km(events[:200], registry) <= 60.0), strict=True)}


def test_same_as_the_small_registry(spark):
    rng = np.random.default_rng(4)
    e, _ = frames(spark, np.column_stack([rng.uniform(24, 50, 400), rng.uniform(-125, -65, 400)]), places(rng, 1))
    p = ports(spark)
    rows = lambda df: sorted((r.event_id, r.port_id, round(r.distance_km, 6)) for r in df.collect())
    assert rows(cells.nearest(e, p, 500.0)) == rows(geo.with_nearest_port(e, 500.0))
    assert rows(cells.within(e, p, 900.0)) == rows(geo.within_radius(e.filter(F.col("lat").isNotNull()), p, 900.0))


def test_a_registry_of_few_bytes_and_many_rows_is_not_broadcast(spark):
    """Its rows go to 27 cubes each, which the optimiser doesn't count: 20,000 rows of a range look like 160 kB."""
    place = ["24 + (id * 7919) % 2600 / 100D AS lat", "-125 + (id * 104729) % 6000 / 100D AS lon"]
    e = spark.range(10).selectExpr("id AS event_id", *place)
    plan = lambda n: cells.within(e, spark.range(n).selectExpr("'p' || id AS port_id", "id AS ord", *place), 120.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(20_000) and "SortMergeJoin" in plan(20_000)
    assert "BroadcastHashJoin" in plan(10)


def test_nearest_of_a_dense_registry(spark):
    """Many rows at few places, and a registry of one city: the search begins with a radius by density, a place is searched for once."""
    rng = np.random.default_rng(5)
    city = np.column_stack([rng.uniform(40, 40.5, 3000), rng.uniform(-74.5, -74, 3000)])
    registry = np.vstack([city, city[:500], [[10.0, 10.0]]])  # the first of equal ones wins
    spots = np.vstack([np.column_stack([rng.uniform(40, 40.5, 20), rng.uniform(-74.5, -74, 20)]), city[:5], [[41.5, -74.2], [10.2, 10.1], [-50.0, 100.0]]])
    events = spots[np.arange(1400) % len(spots)]
    e, p = frames(spark, events, registry)
    assert cells._first_radius(p.select("lat", "lon"), 50.0) < 5 and cells._first_radius(p.filter("ord % 700 = 0").select("lat", "lon"), 50.0) == 50.0
    got = {r.event_id: (r.port_id, r.distance_km, r.ord_) for r in cells.nearest(e, p, 500.0).collect()}
    d = km(events, registry)
    want = {i: int(d[i].argmin()) for i in range(1400) if d[i].min() <= 500}
    assert len(got) == len(want) == 1350 and all(got[i][0] == f"p{j}" and abs(got[i][1] - d[i, j]) < 1e-6 and got[i][2] == 1 for i, j in want.items())
