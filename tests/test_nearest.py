import math
import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.operators import grid, nearest, stations
from emberline.spec import RegionSpec

SMALL = RegionSpec(min_lat=0.0, max_lat=1.2, min_lon=10.0, max_lon=11.0, cell_deg=0.1)


def centre(spec, z):
    r, c = divmod(z, spec.n_cols)
    return spec.min_lat + r * spec.cell_deg + spec.cell_deg / 2, spec.min_lon + c * spec.cell_deg + spec.cell_deg / 2


def brute(spec, points):
    """{(group, zone): (d2, id)} by comparing everything."""
    best = {}
    for g, i, lat, lon in points:
        for z in range(spec.n_zones):
            y, x = centre(spec, z)
            d2 = (y - lat) * (y - lat) + (x - lon) * (x - lon)
            best[g, z] = min(best.get((g, z), (math.inf, 0)), (d2, i))
    return best


def sample(kind, seed=3):
    rng = random.Random(seed)
    rows = []
    if kind == "even":
        rows = [("a", i, rng.uniform(0, 1.2), rng.uniform(10, 11)) for i in range(40)]
    elif kind == "cluster":
        # Nearly all points in one spot far from most zones, some copies, one group of a single point.
        rows = [("a", i, 0.05 + rng.uniform(0, 1e-4), 10.05 + rng.uniform(0, 1e-4)) for i in range(300)]
        rows += [("a", 300 + i, 0.05, 10.05) for i in range(50)]
        rows += [("a", 400, 1.15, 10.9), ("b", 1, 0.6, 10.5)]
    elif kind == "outside":
        rows = [("a", i, rng.uniform(-3, 4), rng.uniform(7, 14)) for i in range(25)]
        rows += [("b", 1, 40.0, -60.0), ("b", 2, 40.0, -60.0)]
    elif kind == "ties":
        # Mirror images: every zone on the axis is equally far from both.
        rows = [("a", 7, 0.65, 10.15), ("a", 2, 0.65, 10.95), ("a", 9, 0.65, 10.15)]
    return rows


def test_a_crowded_tile_is_cut_by_its_content(spark):
    rng = random.Random(9)
    rows = [("a", 5, 5, 0.05 + rng.uniform(0, 8e-4), 10.05 + rng.uniform(0, 8e-4)) for _ in range(20_000)]
    rows += [("a", 7, 7, 0.3, 10.3), ("a", 7, 7, 0.31, 10.3), ("a", 9, 9, 0.5, 10.5)]
    places = spark.createDataFrame(rows, "g STRING, _ty INT, _tx INT, latitude DOUBLE, longitude DOUBLE")
    extent = [f(c).alias(n) for c, lo, hi in (("latitude", "y0", "y1"), ("longitude", "x0", "x1")) for f, n in ((F.min, lo), (F.max, hi))]
    finest = places.groupBy("g", "_ty", "_tx").agg(*extent, F.count("*").alias("n"))
    cut = nearest._parted(places, finest, ["g"])
    sizes = sorted(r["count"] for r in cut.groupBy("_ty", "_tx", "_sy", "_sx").count().collect())
    assert cut.count() == len(rows) and sizes[-1] <= 4 * nearest.CANDIDATES and len(sizes) > 2000


@pytest.mark.parametrize("kind", ["even", "cluster", "outside", "ties"])
def test_nearest_equals_brute_force(spark, kind):
    rows = sample(kind)
    points = spark.createDataFrame(rows, "g STRING, id LONG, latitude DOUBLE, longitude DOUBLE")
    zones = grid.spine(points.select("g").distinct(), SMALL)
    out = nearest.nearest(zones, points, SMALL, ["id"], "p", "id", by=["g"]).collect()
    want = brute(SMALL, rows)
    assert len(out) == len(want)
    for r in out:
        d2, i = want[r.g, r.zone_idx]
        assert r.p_distance_deg == pytest.approx(math.sqrt(d2), abs=1e-12)
        assert r.p_id == i or kind == "cluster" and abs(r.p_distance_deg - math.sqrt(d2)) < 1e-12


def test_group_without_points_keeps_its_zones(spark):
    points = spark.createDataFrame([("a", 1, 0.5, 10.5)], "g STRING, id LONG, latitude DOUBLE, longitude DOUBLE")
    groups = spark.createDataFrame([("a",), ("z",)], "g STRING")
    out = nearest.nearest(grid.spine(groups, SMALL), points, SMALL, ["id"], "p", "id", by=["g"])
    assert out.count() == 2 * SMALL.n_zones
    assert out.where("g = 'z' and p_id is null and p_distance_deg is null").count() == SMALL.n_zones


@pytest.mark.parametrize("radius", [0.03, 0.075, 0.21])
def test_zones_within_equals_brute_force(spark, radius):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-0.2, 1.4), rng.uniform(9.8, 11.2)) for i in range(120)]
    rows += [(900, 0.05 + radius, 10.05), (901, None, 10.0)]
    points = spark.createDataFrame(rows, "id LONG, latitude DOUBLE, longitude DOUBLE")
    got = {(r.id, r.zone_idx) for r in nearest.zones_within(points, SMALL, radius).collect()}
    want = set()
    for i, lat, lon in rows:
        for z in range(SMALL.n_zones):
            y, x = centre(SMALL, z)
            if lat is not None and math.sqrt((y - lat) * (y - lat) + (x - lon) * (x - lon)) <= radius:
                want.add((i, z))
    assert got == want


def test_nearest_within_keeps_a_minority(spark):
    rows = [("a", i, 0.1 * i + 0.04, 10.3, float(i)) for i in range(8)]
    points = spark.createDataFrame(rows, "g STRING, id LONG, latitude DOUBLE, longitude DOUBLE, frp DOUBLE")
    out = nearest.nearest_within(points, SMALL, ["frp"], "fire", "id", by=["g"])
    assert 0 < out.count() < SMALL.n_zones / 2
    assert out.where(F.col("fire_distance_deg") > SMALL.match_radius).count() == 0


def test_grid_is_row_major_with_unique_ids(spark):
    rows = grid.zone_grid(spark, RegionSpec()).orderBy("zone_idx").collect()
    assert len({r.zone_id for r in rows}) == 1400
    assert (rows[36].zone_id, rows[36].row, rows[36].col) == ("G-36", 1, 1)
    assert rows[36].latitude == pytest.approx(11.65) and rows[36].longitude == pytest.approx(74.15)
    assert grid.weather_grid(spark, RegionSpec()).count() == 56
    lattice = grid.query_lattice(spark, RegionSpec(), 4).orderBy("point_idx").collect()
    assert (lattice[0].latitude, lattice[15].longitude) == (11.5, 77.5)
    shape = grid.grid_shape(grid.zone_grid(spark, RegionSpec())).first()
    assert (shape.n_rows, shape.n_cols) == (40, 35)


def test_spread_spine_equals_plain_spine(spark):
    days = spark.createDataFrame([(1,), (2,)], "d INT")
    plain, spread = (grid.spine(days, SMALL, spread=s).orderBy("d", "zone_idx").collect() for s in (False, True))
    assert plain == spread and len(plain) == 2 * SMALL.n_zones


def test_station_fallback(spark):
    spec = RegionSpec(min_lat=10.0, max_lat=12.0, min_lon=70.0, max_lon=72.0)
    st = spark.createDataFrame(
        [(1, 10.1, 70.0), (2, 10.3, 70.0), (3, 11.9, 72.0), (4, 30.0, 70.0)],
        "station_id LONG, latitude DOUBLE, longitude DOUBLE",
    )
    near = stations.stations_near_lattice(st, spec, n_per_side=2)
    ranks = {(r.point_idx, r.station_id): r.station_rank for r in near.collect()}
    assert ranks == {(0, 1): 1, (0, 2): 2, (3, 3): 1}
    daily = spark.createDataFrame(
        [(2, "2024-01-01", 20.0), (1, "2024-02-01", 21.0), (2, "2024-02-01", 22.0), (3, "2024-03-01", 1.0)],
        "station_id LONG, date STRING, temp DOUBLE",
    ).withColumn("date", F.to_date("date"))
    rows = stations.point_weather(
        near, daily.withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)}),
        [("jan", "2024-01-01", "2024-01-31"), ("feb", "2024-02-01", "2024-02-29")],
    ).collect()
    assert {(r.season, r.point_idx, r.station_id, r.temp, r.latitude) for r in rows} == {
        ("jan", 0, 2, 20.0, 10.0),
        ("feb", 0, 1, 21.0, 10.0),
    }


def test_source_merge_keeps_both_sides(spark):
    daily = spark.createDataFrame([(1, "d1", None, 5.0), (2, "d1", 40.0, 6.0)], "station_id INT, date STRING, rhum DOUBLE, temp DOUBLE")
    hourly = spark.createDataFrame([(1, "d1", 10.0), (1, "d1", 20.0), (3, "d1", 7.0)], "station_id INT, date STRING, rhum DOUBLE")
    out = {r.station_id: (r.rhum, r.temp) for r in stations.merge_sources(daily, hourly).collect()}
    assert out == {1: (15.0, 5.0), 2: (40.0, 6.0), 3: (7.0, None)}


def test_growing_tables_are_not_broadcast(spark):
    points = spark.range(300).selectExpr("date_add(date'2024-01-01', cast(id % 2 as int)) as date", "id", "(id % 17) / 14D as latitude", "10 + (id % 5) / 50D as longitude")
    zones = grid.spine(points.select("date").distinct(), SMALL)
    found = nearest.nearest(zones, points, SMALL, ["id"], "p", "id")
    assert len(found.collect()) == 2 * SMALL.n_zones
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"BroadcastHashJoin \[[^]]*\]", plan)
    assert joins and all(re.fullmatch(r"BroadcastHashJoin \[date#\d+\]", j) for j in joins), joins
