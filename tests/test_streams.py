import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from emberline.operators import learn as L
from emberline.operators.sequences import sequences
from emberline.plans import state, windows
from emberline.plans.refresh import ZoneRefresh
from emberline.plans.versions import StateNotReady
from emberline.spec import RegionSpec
from emberline.streaming import detections as D

SCHEMA = "event_id LONG, acq_datetime TIMESTAMP, latitude DOUBLE, longitude DOUBLE, frp DOUBLE"
START = dt.datetime(2024, 1, 1)


def rows(hours):
    out = []
    for h in hours:
        out.append((h, START + dt.timedelta(hours=h), 11.55 + (h % 5) * 0.1, 74.05, float(h)))
    return out


@pytest.fixture
def landed(spark, tmp_path):
    """Three polls, each repeating half of the one before, then a late file."""
    folder = str(tmp_path / "landed")
    for part in (range(0, 20), range(10, 40), range(30, 60), [1]):
        spark.createDataFrame(rows(part), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return D.file_stream(spark, folder, schema, max_files=1)


def test_each_detection_once(spark, landed, tmp_path):
    out = str(tmp_path / "out")
    D.run_available(D.deduplicated(stream(spark, landed), ["event_id"]), out, str(tmp_path / "c"))
    ids = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(60))


def test_windows_equal_batch_over_closed_intervals(spark, landed, tmp_path):
    region = RegionSpec()
    out = str(tmp_path / "out")
    deduped = D.deduplicated(stream(spark, landed), ["event_id"])
    D.run_available(D.zone_windows(deduped, region), out, str(tmp_path / "c"))
    batch = D.zone_windows(spark.createDataFrame(rows(range(60)), SCHEMA), region)
    closed = batch.where(F.col("window_end") <= F.lit(START + dt.timedelta(hours=59) - dt.timedelta(days=1)))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {tuple(r) for r in closed.collect()} and got


FEED = "event_id LONG, date DATE, latitude DOUBLE, longitude DOUBLE, acq_date DATE, acq_time INT, frp DOUBLE, confidence STRING, brightness DOUBLE"
WEATHER = (
    "station_id LONG, date DATE, latitude DOUBLE, longitude DOUBLE, temperature_c DOUBLE, humidity_pct DOUBLE, "
    "wind_speed_ms DOUBLE, wind_deg DOUBLE, precipitation_mm DOUBLE, clouds_pct DOUBLE"
)


def detection(n, day):
    date = dt.date(2024, 1, day)
    return (n, date, 11.55 + n * 0.1, 74.05, date, 100 * n, 5.0 + n, "n", 310.0)


@pytest.fixture
def weather(spark):
    rows = [(1, dt.date(2024, 1, d), 11.6, 74.1, 30.0 + d, 30.0, 5.0, 90.0, 0.0, 10.0) for d in (1, 2, 3)]
    return spark.createDataFrame(rows, WEATHER)


REGION = RegionSpec(min_lat=11.5, max_lat=12.5, min_lon=74.0, max_lon=74.5)


def zone_refresh(spark, base, **more):
    feeds = (spark.createDataFrame([], s).schema for s in (FEED, WEATHER))
    return ZoneRefresh(str(base), REGION, *feeds, **more)


def state_rows(zones, spark, version=None):
    rows = zones.state.read(spark, version).select("date", "zone_idx", "active_fire_nearby", "fire_frp", "wx_temperature_c", "risk_score")
    return sorted(tuple(r) for r in rows.collect())


def hotter(weather, degrees):
    return weather.withColumn("temperature_c", F.col("temperature_c") + degrees)


def test_landed_dates_have_few_files(spark, tmp_path):
    zones = zone_refresh(spark, tmp_path)
    feed = spark.createDataFrame([detection(n, 1 + n % 3) for n in range(24)], FEED)
    zones.land("detections", feed.repartition(8), 7)
    days = zones.dates_of(spark, "detections", 7)
    assert len(days) == 3 and zones.dates_of(spark, "detections", 8) == []
    assert len(list(tmp_path.glob("detections/date=*/batch_id=7/*.parquet"))) == len(days)
    assert zones.landed(spark, "detections", days).count() == 24


def test_refresh_keeps_each_zone_day_once(spark, weather, tmp_path):
    batches = [[detection(0, 1), detection(1, 2)], [detection(2, 1), detection(0, 1)], [detection(3, 2)]]
    frames = [spark.createDataFrame(b, FEED) for b in batches]
    step, whole = zone_refresh(spark, tmp_path / "step"), zone_refresh(spark, tmp_path / "whole")
    step.on_weather(weather, 0)
    for n, batch in enumerate(frames):
        step.on_detections(batch, n)
    once = state_rows(step, spark)
    step.on_detections(frames[1], 1)  # a replay
    assert state_rows(step, spark) == once
    everything = spark.createDataFrame(sorted({r for b in batches for r in b}), FEED)
    whole.on_detections(everything, 0)  # detections before there is any weather
    with pytest.raises(StateNotReady):
        whole.state.read(spark)
    whole.on_weather(weather, 0)
    assert once == state_rows(whole, spark)
    assert len(once) == 3 * REGION.n_zones and sum(r[2] for r in once) > 0


def test_newer_weather_moves_its_dates_only(spark, weather, tmp_path):
    zones = zone_refresh(spark, tmp_path / "base")
    with pytest.raises(StateNotReady):
        zones.state.read(spark)
    assert state.summary_of(zones.state, spark).head()["status"] == "not_initialised"
    zones.on_weather(weather, 0)
    zones.on_detections(spark.createDataFrame([detection(1, 3)], FEED), 0)
    before = state_rows(zones, spark)
    zones.on_weather(hotter(weather, 10.0).where("date < DATE '2024-01-03'"), 1)
    after = state_rows(zones, spark)
    assert [b[4] - a[4] for a, b in zip(before, after)] == [10.0] * (2 * REGION.n_zones) + [0.0] * REGION.n_zones
    whole = zone_refresh(spark, tmp_path / "whole")
    both = hotter(weather, 10.0).where("date < DATE '2024-01-03'").union(weather.where("date = DATE '2024-01-03'"))
    whole.on_weather(both, 0)
    whole.on_detections(spark.createDataFrame([detection(1, 3)], FEED), 0)
    assert after == state_rows(whole, spark)
    # Detections of a day whose weather changed before are judged by the new weather.
    zones.on_detections(spark.createDataFrame([detection(2, 1)], FEED), 1)
    assert {r[4] for r in state_rows(zones, spark) if r[0].day == 1} == {41.0}
    versions = {r["date"].day: (r["version"], r["detections"], r["weather"]) for r in zones.state.ledger(spark).collect()}
    assert versions == {1: (4, 1, 1), 2: (3, None, 1), 3: (2, 0, 0)}


def test_versions_are_whole_and_stay(spark, weather, tmp_path):
    zones = zone_refresh(spark, tmp_path / "base")
    zones.on_weather(weather, 0)
    first = state_rows(zones, spark)
    pinned = zones.state.read(spark).select("date", "zone_idx", "wx_temperature_c")
    zones.on_weather(hotter(weather, 5.0), 1)
    assert sorted(r["wx_temperature_c"] for r in pinned.collect()) == sorted(r[4] for r in first)
    assert state_rows(zones, spark, 1) == first != state_rows(zones, spark)
    # A write that breaks off before its ledger is not a version, and the next one replaces it.
    (tmp_path / "base/zone_state/files/version=3/date=2024-01-01").mkdir(parents=True)
    (tmp_path / "base/zone_state/ledger/3").mkdir()
    assert zones.state.numbers(spark) == [1, 2]
    zones.on_weather(weather.where("false"), 2)  # touches nothing
    assert zones.state.numbers(spark) == [1, 2]
    zones.on_weather(weather, 3)
    assert zones.state.numbers(spark) == [1, 2, 3] and state_rows(zones, spark) == first
    assert {r["date"].day for r in state.newest(zones.state, spark).select("date").distinct().collect()} == {3}
    with pytest.raises(StateNotReady):
        zones.state.read(spark, 9)


def test_a_saved_model_scores_the_next_refresh(spark, weather, tmp_path):
    path = str(tmp_path / "model")
    zones = zone_refresh(spark, tmp_path / "base", model_path=path)
    zones.on_weather(weather, 0)
    ruled = state_rows(zones, spark)
    rows = spark.createDataFrame([(float(i), 50.0 - i, i % 2) for i in range(40)], "wx_temperature_c DOUBLE, wx_humidity_pct DOUBLE, fire_risk_label INT")
    assembled = VectorAssembler(inputCols=["wx_temperature_c", "wx_humidity_pct"], outputCol="features")
    L.save(Pipeline(stages=[assembled, LogisticRegression(labelCol="fire_risk_label")]).fit(rows), path)
    zones.on_weather(weather, 1)
    scored = state_rows(zones, spark)
    assert [r[:5] for r in scored] == [r[:5] for r in ruled] and [r[5] for r in scored] != [r[5] for r in ruled]


def test_refresh_runs_on_streams(spark, weather, tmp_path):
    zones = zone_refresh(spark, tmp_path / "base")
    for kind, rows, run in (("weather", [weather], zones.on_weather), ("hot", [spark.createDataFrame([detection(d, d)], FEED) for d in (1, 2)], zones.on_detections)):
        for part in rows:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        D.run_refresh(D.file_stream(spark, str(tmp_path / kind), rows[0].schema, max_files=1), run, str(tmp_path / f"check_{kind}"))
    assert len(state_rows(zones, spark)) == 3 * REGION.n_zones
    assert zones.state.numbers(spark) == [1, 2, 3]


def test_windows_follow_the_state(spark, tmp_path):
    rows = [(1, dt.date(2024, 1, d), 11.6, 74.1, 30.0 + d, 30.0, 5.0, 90.0, 0.0, 10.0) for d in range(1, 13) if d != 9]
    weather = spark.createDataFrame(rows, WEATHER)
    zones = zone_refresh(spark, tmp_path / "base")
    table = windows.window_table(str(tmp_path / "windows"))
    features = ["wx_temperature_c", "fwi"]

    def built():
        return sorted((r["date"], r["zone_idx"], r["sequence"]) for r in table.read(spark).collect())

    def whole():
        seq = sequences(zones.state.read(spark), 3, features, label=None)
        return sorted((r["date"], r["zone_idx"], r["sequence"]) for r in seq.collect())

    zones.on_weather(weather.where("date < DATE '2024-01-08'"), 0)
    assert windows.refresh_windows(spark, zones.state, table, features, 3) == 1 and built() == whole()
    zones.on_weather(weather.where("date >= DATE '2024-01-08'"), 1)
    assert windows.refresh_windows(spark, zones.state, table, features, 3) == 2 and built() == whole()
    zones.on_weather(hotter(weather, 3.0).where("date = DATE '2024-01-04'"), 2)
    assert windows.refresh_windows(spark, zones.state, table, features, 3) == 3 and built() == whole()
    assert windows.refresh_windows(spark, zones.state, table, features, 3) is None
    last = {r["date"].day for r in table.ledger(spark).collect() if r["version"] == 3}
    assert last == {4, 5, 6} and len({d for d, _, _ in built()}) == 7


def test_only_stale_windows_need_their_days():
    day = [dt.date(2024, 1, d) for d in range(1, 8)]
    state_versions = dict.fromkeys(day, 1) | {day[2]: 4}
    first = windows.stale_ends(state_versions, {}, 3)
    assert set(first) == set(day) and first[day[4]] == 4 and first[day[5]] == 1
    assert windows.stale_ends(state_versions, dict.fromkeys(day, 1), 3) == {day[2]: 4, day[3]: 4, day[4]: 4}
