"""Joins of located rows with a registry of any size, over cells of the sphere.

A place on the sphere is a point of the unit ball, and the ball is cut into cubes whose side is the chord of the radius. Two places
within the radius lie in the same cube or in neighbouring ones, also at the poles and across the date line, where degrees would
need cases. The registry's rows go to their own cube and its 26 neighbours, so each located row looks into one cube: an equi-join,
which Spark can split where a cube is crowded. Distances of what meets are then worked out exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.scalar import EARTH_KM, haversine_km
from quaystone.sources.lake import scratch

#: First radius of a search for the nearest, where the registry isn't dense; it doubles until every row has one.
FIRST_KM = 50.0
#: Registries up to so many rows are broadcast (27 rows each). The optimiser would judge by the file's size, before rows are multiplied.
BROADCAST_ROWS = 4096
#: Places of the registry in the cube of one of them, on average, with which a search for the nearest begins.
CROWDED = 4.0
#: Smallest first radius.
LEAST_KM = 0.05
_HALF_WAY = math.pi * EARTH_KM


def _side(km: float) -> float:
    """Side of the cubes for a radius, a little over its chord, as sums of doubles are not exact."""
    return 2 * math.sin(min(km, _HALF_WAY) / (2 * EARTH_KM)) * (1 + 1e-9) + 1e-9


_CUBE = ["__x", "__y", "__z"]


def _cube(lat: Column, lon: Column, side: float) -> dict[str, Column]:
    north, east = F.radians(lat), F.radians(lon)
    point = (F.cos(north) * F.cos(east), F.cos(north) * F.sin(east), F.sin(north))
    return {name: F.floor((x + 1) / side).cast("long") for name, x in zip(_CUBE, point, strict=True)}


def within(df: DataFrame, registry: DataFrame, km: float) -> DataFrame:
    """Each row of df (lat, lon, ...) with every row of the registry (port_id, ord, lat, lon) within km: port_id, ord, distance_km.
    Rows without coordinates go. The registry is looked at once, for whether it is small enough to broadcast."""
    side = _side(km)
    places = registry.filter("lat IS NOT NULL AND lon IS NOT NULL").select("port_id", "ord", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    small = len(places.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    places = places.withColumns(_cube(F.col("__lat"), F.col("__lon"), side))
    for c in _CUBE:
        places = places.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    rows = df.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumns(_cube(F.col("lat"), F.col("lon"), side))
    met = rows.join(places.hint("broadcast" if small else "merge"), _CUBE).withColumn("distance_km", haversine_km(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")))
    return met.filter(F.col("distance_km") <= km).drop(*_CUBE, "__lat", "__lon")


def _first_radius(places: DataFrame, km: float) -> float:
    """km, or a smaller radius with which a place of the registry has about CROWDED in its cube, itself counted."""
    while km > LEAST_KM:
        cubes = places.select(*[x.alias(c) for c, x in _cube(F.col("lat"), F.col("lon"), _side(km)).items()]).groupBy(*_CUBE).agg(F.count("*").cast("double").alias("n"))
        crowd = cubes.agg(F.sum(F.col("n") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).first()[0]
        if crowd is None or crowd <= 2 * CROWDED:
            return km
        km = max(LEAST_KM, km * max(1 / 16, math.sqrt(CROWDED / crowd)))
    return km


def nearest(df: DataFrame, registry: DataFrame, km: float | None = None, first_km: float = FIRST_KM) -> DataFrame:
    """df (lat, lon, ...) with port_id and distance_km of the nearest row of the registry, the first by ord of those that are as near to
    a millimetre. Rows without coordinates or with none within km go.

    Different places are searched for once, however many rows lie there, and so is the registry's; df is read twice. Places that find
    none in a radius try the double one; the first is smaller where the registry is dense, so that a place meets a few of its rows.
    Each round is written, as it is used twice, and there are about 20 at most."""
    spark, out, base = df.sparkSession, None, f"{scratch(df.sparkSession)}/nearest"
    rows = df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    limit = _HALF_WAY if km is None else km
    first = F.min(F.struct("ord", "port_id")).alias("first")
    sites = registry.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(first).select("lat", "lon", "first.*")
    sites.write.parquet(f"{base}/sites")
    sites = spark.read.schema(sites.schema).parquet(f"{base}/sites")
    radius = _first_radius(sites, min(first_km, limit))
    rest = rows.select(F.col("lat").alias("__lat0"), F.col("lon").alias("__lon0")).distinct()
    rest.write.parquet(f"{base}/0")
    rest = spark.read.schema(rest.schema).parquet(f"{base}/0")
    at, number = ["__lat0", "__lon0"], 0
    while True:
        best = F.min(F.struct(F.round("distance_km", 6).alias("r"), "ord", "port_id", F.col("distance_km").alias("km"))).alias("best")
        met = within(rest.withColumns({"lat": F.col("__lat0"), "lon": F.col("__lon0")}), sites, radius).groupBy(*at).agg(best)
        number += 1
        both = rest.join(met, at, "left")
        both.write.parquet(f"{base}/{number}")
        both = spark.read.schema(both.schema).parquet(f"{base}/{number}")
        found = both.filter("best IS NOT NULL").select(*at, F.col("best.port_id").alias("port_id"), F.col("best.km").alias("distance_km"))
        out = found if out is None else out.unionByName(found)
        rest = both.filter("best IS NULL").drop("best")
        if radius >= limit or rest.isEmpty():
            return rows.join(out, (F.col("lat") == F.col("__lat0")) & (F.col("lon") == F.col("__lon0"))).drop(*at)
        radius = min(2 * radius, limit)
