"""Attribution of located events to ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.scalar import haversine_km
from quaystone.operators import cells
from quaystone.registry import PORTS


def nearest_literal(lat: Column, lon: Column) -> Column:
    """Struct (km, ord, port_id) of the nearest port of the registry, the first on ties: ten expressions, no join and no shuffle."""
    options = [F.struct(haversine_km(lat, lon, F.lit(p[2]), F.lit(p[3])).alias("km"), F.lit(i).alias("ord"), F.lit(p[0]).alias("port_id")) for i, p in enumerate(PORTS)]
    return F.array_min(F.array(*options))


def with_nearest_port(df: DataFrame, radius_km: float | None = None) -> DataFrame:
    """df (lat, lon, ...) with port_id and distance_km of the nearest port; rows without coordinates or beyond the radius go."""
    out = df.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("__near", nearest_literal(F.col("lat"), F.col("lon")))
    out = out.withColumns({"port_id": F.col("__near.port_id"), "distance_km": F.col("__near.km")}).drop("__near")
    return out if radius_km is None else out.filter(F.col("distance_km") <= radius_km)


def within_radius(df: DataFrame, ports: DataFrame, radius_km: float) -> DataFrame:
    """Each row of df with every port within the radius, by cells of the sphere: port_id, ord, distance_km."""
    return cells.within(df, ports, radius_km)


def first_port_wins(df: DataFrame, key: str) -> DataFrame:
    """Of rows that several ports claim, the one of the first port in registry order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def registry_box(margin: float = 3.0) -> tuple[float, float, float, float]:
    """Bounding box of the registry: west, south, east, north."""
    lats, lons = [p[2] for p in PORTS], [p[3] for p in PORTS]
    return min(lons) - margin, min(lats) - margin, max(lons) + margin, max(lats) + margin


def in_box(df: DataFrame, margin: float = 3.0) -> DataFrame:
    """Rows inside the registry's box, as literal bounds that reach the scan."""
    west, south, east, north = registry_box(margin)
    return df.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
