import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import spread as S
from emberline.operators import adjacency as N
from emberline.operators import alerts as A
from emberline.plans import spread, state
from emberline.spec import AlertSpec, RegionSpec, SpreadSpec

TEN = RegionSpec(min_lat=0.0, max_lat=1.0, min_lon=0.0, max_lon=1.0)


def test_threshold_severity_and_reason(spark):
    rows = [
        (0, "A", 12.0, 75.0, False, 10.0, 1.0, 0.2),
        (1, "B", 12.0, 75.0, True, 90.0, 5.0, 0.95),
        (2, "C", 12.0, 75.0, False, 50.0, 2.0, 0.5),
        (3, "D", 12.0, 75.0, False, 20.0, 9.0, 0.7),
        (4, "E", 12.0, 75.0, False, 20.0, 1.0, 0.75),
        (5, "F", 12.0, 75.0, False, 20.0, 1.0, float("nan")),
        (6, "H", 12.0, 75.0, False, 20.0, 1.0, None),
    ]
    df = spark.createDataFrame(
        rows,
        "zone_idx INT, zone_id STRING, latitude DOUBLE, longitude DOUBLE, active_fire_nearby BOOLEAN, fwi DOUBLE, "
        "wx_wind_speed_ms DOUBLE, risk_score DOUBLE",
    )
    out = A.ranked(A.alerts(df, AlertSpec())).collect()
    assert [(r.zone_id, r.severity, r.reason) for r in out] == [
        ("B", "EXTREME", "active satellite hotspot nearby; extreme FWI (90.0)"),
        ("E", "HIGH", "elevated model risk score"),
        ("D", "HIGH", "high wind (9.0 m/s)"),
    ]
    assert [r.zone_id for r in A.top_alerts(A.alerts(df), 1).collect()] == ["B"]
    left = A.remainder(A.alerts(df), 2).first()
    assert (left.total_alerts, left.more_alerts) == (3, 1)


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.75,), (0.50,), (0.10,), (None,)], "s DOUBLE")
    out = [r[0] for r in df.select(A.severity("s", AlertSpec())).collect()]
    assert out == ["EXTREME", "HIGH", "MODERATE", "LOW", None]


def cells(spark, burning, bare=(), dry=0.8, load=0.8, n=10):
    rows = []
    for r in range(n):
        for c in range(n):
            s = S.NON_FUEL if (r, c) in bare else S.BURNING if (r, c) in burning else S.UNBURNED
            rows.append(("d", r, c, s, dry, load))
    return spark.createDataFrame(rows, "date STRING, row INT, col INT, state INT, dryness DOUBLE, fuel DOUBLE")


def wind(spark, ms=3.0, deg=180.0):
    return spark.createDataFrame([("d", ms, deg)], "date STRING, mean_wind_ms DOUBLE, mean_wind_deg DOUBLE")


def test_exposure_matches_the_formula(spark):
    burning = {(5, 5), (5, 6), (0, 0)}
    out = {
        r.zone_idx: r.p_ignite
        for r in N.ignition_probability(cells(spark, burning), wind(spark), TEN).collect()
    }
    want = {}
    for br, bc in burning:
        for dr, dc, bearing in S.NEIGHBOURS:
            r, c = br + dr, bc + dc
            if 0 <= r < 10 and 0 <= c < 10 and (r, c) not in burning:
                turn = abs(bearing - 0.0)
                turn = min(turn, 360 - turn)
                f = min(max(1 + 0.8 * math.cos(math.radians(turn)), 0.4), 1.8)
                p = min(0.35 * 0.8 * 0.8 * f * 1.3, 0.97)
                want[r * 10 + c] = 1 - (1 - want.get(r * 10 + c, 0.0)) * (1 - p)
    assert out.keys() == want.keys()
    assert all(out[z] == pytest.approx(want[z]) for z in want)


def test_bare_cells_are_never_exposed(spark):
    out = N.ignition_probability(cells(spark, {(5, 5)}, bare={(5, 6)}), wind(spark), TEN)
    zones = {r.zone_idx for r in out.collect()}
    assert 56 not in zones and len(zones) == 7


def test_nothing_spreads_without_fuel(spark):
    c = cells(spark, {(4, 4)}, dry=0.0, load=0.0, n=8)
    region = RegionSpec(min_lat=0.0, max_lat=0.8, min_lon=0.0, max_lon=0.8)
    exposed = N.ignition_probability(c, wind(spark, 10.0, 0.0), region)
    assert exposed.agg(F.sum("p_ignite")).first()[0] == 0.0
    step = N.next_step(c, exposed).first()
    assert (step.expected_new_burning, step.n_burned_after) == (0.0, 1)


def test_row_axis_mirrors_north_and_south(spark):
    one = cells(spark, {(5, 5)})
    up, ref = (
        {r.zone_idx: r.p_ignite for r in N.ignition_probability(one, wind(spark), TEN, SpreadSpec(row_axis=a)).collect()}
        for a in ("north_up", "reference")
    )
    # Southerly wind: downwind is row 4 in one reading and row 6 in the other.
    assert ref[45] == pytest.approx(up[65]) and ref[45] > ref[65]


def test_edges_respect_the_border(spark):
    edges = N.neighbour_edges(cells(spark, {(0, 0)}).where("state = 1"), TEN).collect()
    assert {(e.to_zone, e.bearing) for e in edges} == {(1, 90), (11, 135), (10, 180)}


def test_initial_state_order(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False)], "i BOOLEAN, b BOOLEAN")
    assert [r[0] for r in df.select(S.initial_state("i", "b")).collect()] == [3, 1, 0]


def test_snapshots(spark):
    one = spark.createDataFrame([(0, 0.2, 10.0), (1, 0.95, 90.0)], "zone_idx INT, risk_score DOUBLE, fwi DOUBLE")
    two = spark.createDataFrame([(0, 0.8, 80.0)], "zone_idx INT, risk_score DOUBLE, fwi DOUBLE")
    times = ("2024-01-01 00:00:00", "2024-01-01 00:15:00")
    one, two = (df.withColumn("refreshed_at", F.lit(t).cast("timestamp")) for df, t in zip((one, two), times))
    history = one.union(two)
    now = state.current_state(history)
    assert {(r.zone_idx, r.risk_score) for r in now.collect()} == {(0, 0.8), (1, 0.95)}
    s = state.summary(now, by=[]).first()
    assert (s.total_zones, s.total_alerts, s.n_extreme, s.n_high, s.max_risk_score) == (2, 2, 1, 1, 0.95)
    seq = state.snapshot_sequences(history, ["fwi"], 2).collect()
    assert [(r.zone_idx, r.sequence) for r in seq] == [(0, [[10.0], [80.0]])]


def test_member_seeds(spark):
    zones = spark.createDataFrame(
        [("d", 0, 80.0, 0.5, False), ("d", 1, 80.0, 0.1, False), ("d", 2, 80.0, 0.5, True)],
        "date STRING, zone_idx INT, ffmc DOUBLE, ndvi DOUBLE, active_fire_nearby BOOLEAN",
    )
    hot = spark.createDataFrame([("d", 0), ("d", 1)], "date STRING, zone_idx INT")
    by_list = {r.zone_idx: r.state for r in spread.member_seeds(zones, hot).collect()}
    by_fire = {r.zone_idx: r.state for r in spread.fire_seeds(zones).collect()}
    assert by_list == {0: 1, 1: 3, 2: 0} and by_fire == {0: 0, 1: 3, 2: 1}
