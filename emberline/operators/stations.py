"""Choosing weather stations for query points and merging their sources."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from emberline.functions.scalar import EARTH_RADIUS_KM, haversine_km
from emberline.operators.grid import lattice_position
from emberline.spec import RegionSpec

# Search radius in kilometres and number of stations tried.
SEARCH_RADIUS_KM = 150.0
STATIONS_TRIED = 8

KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def stations_near_lattice(
    stations: DataFrame,
    spec: RegionSpec,
    n_per_side: int = 4,
    radius_km: float = SEARCH_RADIUS_KM,
    limit: int = STATIONS_TRIED,
) -> DataFrame:
    """The ``limit`` nearest stations of each lattice point, ranked from one.

    A station is unfolded into the lattice points of its bounding box, so there
    is no join; the rank filter is applied per task before the exchange, which
    then carries at most ``limit`` rows per point and task.
    """
    last = max(n_per_side - 1, 1)
    step_lat = (spec.max_lat - spec.min_lat) / last
    step_lon = (spec.max_lon - spec.min_lon) / last
    dlat = F.lit(radius_km / KM_PER_DEGREE)
    # The circle's widest longitude reach, and the whole lattice near a pole.
    ratio = F.sin(F.lit(radius_km / EARTH_RADIUS_KM)) / F.cos(F.radians("latitude"))
    dlon = F.when(ratio < 1, F.degrees(F.asin(ratio))).otherwise(F.lit(360.0))

    def edges(value, reach, origin, step):
        low = F.ceil((F.col(value) - reach - origin) / step - 1e-9).cast("int")
        high = F.floor((F.col(value) + reach - origin) / step + 1e-9).cast("int")
        return F.greatest(low, F.lit(0)), F.least(high, F.lit(n_per_side - 1))

    i0, i1 = edges("latitude", dlat, spec.min_lat, step_lat)
    j0, j1 = edges("longitude", dlon, spec.min_lon, step_lon)
    s = stations.where("latitude is not null and longitude is not null")
    s = s.withColumns({"_i0": i0, "_i1": i1, "_j0": j0, "_j1": j1}).where("_i1 >= _i0 and _j1 >= _j0")
    s = s.withColumn("_i", F.explode(F.sequence("_i0", "_i1")))
    s = s.withColumn("_j", F.explode(F.sequence("_j0", "_j1")))
    plat, plon = lattice_position(F.col("_i"), F.col("_j"), spec, n_per_side)
    pairs = s.select(
        (F.col("_i") * n_per_side + F.col("_j")).alias("point_idx"),
        plat.alias("point_latitude"),
        plon.alias("point_longitude"),
        "station_id",
        haversine_km(plat, plon, "latitude", "longitude").alias("distance_km"),
    ).where(F.col("distance_km") <= radius_km)
    # Rounded so that the order does not hang on the last bit of a sine.
    order = Window.partitionBy("point_idx").orderBy(F.round("distance_km", 6), "station_id")
    return pairs.withColumn("station_rank", F.row_number().over(order)).where(
        F.col("station_rank") <= limit
    )


def in_ranges(daily: DataFrame, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows inside each (label, first day, last day) range, with the label as
    ``season``. The ranges are arguments of the call, so no join is needed; a
    row in two overlapping ranges appears in both. The plain date ranges come
    first, so that the scan can skip files and row groups."""
    inside = [F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) for _, start, end in ranges]
    if not ranges:
        return daily.where(F.lit(False)).withColumn("season", F.lit(""))
    labels = [F.when(test, F.lit(label)) for test, (label, _, _) in zip(inside, ranges)]
    return daily.where(reduce(or_, inside)).withColumn("season", F.explode(F.array_compact(F.array(*labels))))


def choose_stations(near: DataFrame, daily: DataFrame, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per season and point: the nearest listed station that has any row."""
    present = in_ranges(daily.select("station_id", "date"), ranges).select("station_id", "season").distinct()
    first = F.min(F.struct("station_rank", "station_id", "point_latitude", "point_longitude"))
    return (
        near.join(present, "station_id")
        .groupBy("season", "point_idx")
        .agg(first.alias("_s"))
        .select("season", "point_idx", "_s.*")
    )


def point_weather(near: DataFrame, daily: DataFrame, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Daily rows of each point's chosen station, at the point's coordinates."""
    chosen = choose_stations(near, daily, ranges).withColumnsRenamed(
        {"point_latitude": "latitude", "point_longitude": "longitude"}
    )
    rows = in_ranges(daily.drop("latitude", "longitude"), ranges)
    return rows.join(chosen, ["season", "station_id"])


def merge_sources(daily: DataFrame, hourly: DataFrame, fields: tuple[str, ...] = ("rhum",)) -> DataFrame:
    """Daily values, with gaps filled by the mean of the station's hourly ones.

    Stations and days known to only one source are kept.
    """
    keys = ["station_id", "date"]
    derived = hourly.groupBy(*keys).agg(*[F.avg(f).alias(f"_h_{f}") for f in fields])
    return (
        daily.join(derived, keys, "full")
        .withColumns({f: F.coalesce(f, f"_h_{f}") for f in fields})
        .drop(*[f"_h_{f}" for f in fields])
    )
