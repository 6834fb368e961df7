"""Streaming jobs, run over the available files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import schemas
from emberline.catalog import frames as X
from emberline.catalog import views as V
from emberline.catalog.kept import once
from emberline.catalog.q_sources import mixed_files
from emberline.catalog.reference_sql import one_decimal
from emberline.catalog.registry import query
from emberline.functions.scalar import acquisition_time
from emberline.operators import alerts as A
from emberline.operators.dedup import DETECTION_KEYS, stitch
from emberline.plans import daily, refresh, state, windows
from emberline.schemas import TRAINING_FEATURES
from emberline.session import scratch_dir
from emberline.spec import AlertSpec
from emberline.sources import readers as R
from emberline.sources.writers import write_table
from emberline.streaming import detections as D


_FWI = TRAINING_FEATURES.index("fwi")
_LAGS = ", ".join(f"lag(fwi, {6 - i}) over w as f{i}" for i in range(7))
_FWIS = ", ".join(f"round(f{i}, 4) as fwi_{i}" for i in range(7))


def _landed(spark, sf, view):
    """Detections landed as Parquet files, read as a stream with event time."""
    folder = scratch_dir(spark, "landed")
    hot = view(spark, sf).withColumn("acq_datetime", F.col("ts").cast("timestamp")).drop("ts")
    write_table(hot, folder)
    return D.file_stream(spark, folder, hot.schema)


def refreshed(spark, sf) -> refresh.ZoneRefresh:
    """The zone state after five landings of two feeds, each a micro-batch:
    weather, of which the last eleven days are ten degrees too hot, detections
    up to the tenth, the last eleven days' weather again as it should be, and
    two more landings of detections. Each of detections repeats four days of
    the one before."""

    def run():
        base = scratch_dir(spark, "refresh")
        hot = X.detections(spark, sf).withColumn("acq_datetime", F.col("ts").cast("timestamp")).drop("ts")
        weather, day = V.weather_now(spark, sf), F.dayofmonth("date")
        off = weather.withColumn("temperature_c", F.when(day > 20, F.col("temperature_c") + 10).otherwise(F.col("temperature_c")))
        zones = refresh.ZoneRefresh(base, X.REGION, hot.schema, weather.schema, V.ndvi_obs(spark, sf))
        feeds = {"weather": zones.on_weather, "detections": zones.on_detections}
        for kind, rows in (
            ("weather", off),
            ("detections", hot.where(day <= 10)),
            ("weather", weather.where(day > 20)),
            ("detections", hot.where((day > 6) & (day <= 20))),
            ("detections", hot.where(day > 16)),
        ):
            folder = f"{base}/feed_{kind}"
            rows.write.mode("append").parquet(folder)
            D.run_refresh(D.file_stream(spark, folder, rows.schema), feeds[kind], f"{base}/check_{kind}")
        return zones

    return once(spark, sf, "refreshed", run)


def _sink(spark, stream):
    out, check = scratch_dir(spark, "stream"), scratch_dir(spark, "stream_check")
    D.run_available(stream, out, check)
    return spark.read.schema(stream.schema).parquet(out)


@query("ts1_deduplicated_stream", "select event_id, date, round(frp, 4) as frp from hotspots")
def ts1(spark, sf):
    """Detections of repeated polls, each once."""
    stream = D.deduplicated(_landed(spark, sf, V.hotspots_repolled), DETECTION_KEYS)
    return _sink(spark, stream.select("event_id", "date", F.round("frp", 4).alias("frp")))


def _quarantined(spark, sf):
    """What a stream over files with broken lines and error answers landed."""
    out = scratch_dir(spark, "quarantined")
    D.run_quarantine(spark, f"{mixed_files(spark, sf)}/*/*", out, scratch_dir(spark, "quarantine_check"), schemas.HOTSPOT)
    return out, spark.read.schema(D.landed_schema(schemas.HOTSPOT)).parquet(out)


@query(
    "ts1_accepted_stream",
    """select latitude, longitude, acq_date, acq_time, round(frp, 4) as frp from hotspots where event_id%7<>0 and day(acq_date)%5<>0""",
)
def ts1_accepted(spark, sf):
    """Text files to rows to detections, each once, in two streams: error answers and broken lines are left behind."""
    out, landed = _quarantined(spark, sf)
    stream = D.accepted(D.file_stream(spark, out, landed.schema), landed)
    timed = stream.withColumn("acq_datetime", acquisition_time("acq_date", "acq_time"))
    rows = D.deduplicated(timed, DETECTION_KEYS).select("latitude", "longitude", "acq_date", "acq_time", F.round("frp", 4).alias("frp"))
    return _sink(spark, rows)


@query(
    "ts1_refused_lines",
    """select day(acq_date) as day, concat('broken,,', event_id) as line from hotspots where event_id%7=0 and day(acq_date)%5<>0
    union all select distinct day(acq_date), null from hotspots where day(acq_date)%5=0""",
)
def ts1_refused(spark, sf):
    """What the same stream refused: lines of data files, and whole files (null)."""
    _, landed = _quarantined(spark, sf)
    refused = D.refused_rows(landed).unionByName(D.refused_files(landed).withColumn("line", F.lit(None).cast("string")))
    return refused.select(F.regexp_extract("file_path", "day=([0-9]+)", 1).cast("long").alias("day"), "line")


@query(
    "ts2_zone_windows",
    """select time_bucket(interval '15 minutes', ts) as window_start, time_bucket(interval '15 minutes', ts)+interval '15 minutes' as window_end,
    zone_idx, count(*) as n_detections, round(sum(frp), 4) as frp_sum, round(max(frp), 4) as frp_max
    from (select h.ts, p.zone_idx, h.frp from hotspots h join fire_pairs p on p.event_id=h.event_id) j
    where time_bucket(interval '15 minutes', ts)+interval '15 minutes' <= (select max(ts)-interval '1 day' from hotspots)
    group by 1, 2, 3""",
)
def ts2(spark, sf):
    """Closed quarter hours per zone: detections and radiative power."""
    stream = D.deduplicated(_landed(spark, sf, V.hotspots_repolled), DETECTION_KEYS)
    rows = _sink(spark, D.zone_windows(stream, X.REGION))
    return X.rounded(rows).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


@query("ts3_refresh_alerts", "select date, zone_idx, severity, reason from alert_rows")
def ts3(spark, sf):
    """Alerts of a state that followed detections and newer weather for the same dates."""
    return A.alerts(refreshed(spark, sf).state.read(spark)).select("date", "zone_idx", "severity", "reason")


@query(
    "ts3_date_versions",
    """select date, max(v) as version, max(case when kind='w' then v end) = 3 as weather_again from (
      select date, 1 as v, 'w' as kind from weather_now union all select date, 3, 'w' from weather_now where day(date)>20
      union all select date, 2, 'd' from hotspots where day(date)<=10 union all select date, 4, 'd' from hotspots where day(date)>6 and day(date)<=20
      union all select date, 5, 'd' from hotspots where day(date)>16) e group by date having bool_or(kind='w')""",
)
def ts3_versions(spark, sf):
    """Which version of the state wrote each date: only touched dates are written."""
    rows = refreshed(spark, sf).state.ledger(spark).where("version is not null")
    return rows.select("date", "version", (F.col("weather") > 0).alias("weather_again"))


@query(
    "ts4_current_state",
    """select zone_idx, date, round(risk_score, 4) as risk_score, severity from (select *, row_number() over
    (partition by zone_idx order by date desc) as rn from banded) b where rn=1""",
)
def ts4(spark, sf):
    """Latest row of every zone in the state that the refresh keeps."""
    rows = state.newest(refreshed(spark, sf).state, spark)
    return X.rounded(rows.select("zone_idx", "date", "risk_score", A.severity("risk_score", AlertSpec()).alias("severity")))


@query(
    "ts4_first_version",
    f"""select date, zone_idx, severity, case when why='' then 'elevated model risk score' else why end as reason
    from (select *, concat_ws('; ', case when fwi>60 then concat('extreme FWI (', {one_decimal("fwi")}, ')') end,
        case when wx_wind_speed_ms>8 then concat('high wind (', {one_decimal("wx_wind_speed_ms")}, ' m/s)') end) as why
      from banded where risk_score>=0.7 and day(date)<=20) a""",
)
def ts4_first(spark, sf):
    """An older version, read after four newer ones: no detections yet."""
    rows = refreshed(spark, sf).state.read(spark, version=1).where(F.dayofmonth("date") <= 20)
    return A.alerts(rows).select("date", "zone_idx", "severity", "reason")


@query(
    "ts4_status",
    """select 'ok' as status, count(*) as total_zones, count(*) filter (where risk_score>=0.7) as total_alerts,
    count(*) filter (where severity='EXTREME') as n_extreme, count(*) filter (where severity='HIGH') as n_high,
    round(max(risk_score), 4) as max_risk_score, round(avg(risk_score), 4) as mean_risk_score from banded""",
)
def ts4_status(spark, sf):
    """Status and numbers of the newest version."""
    return X.rounded(state.summary_of(refreshed(spark, sf).state, spark).drop("timestamp"))


@query(
    "w4_refreshed_windows",
    f"""select zone_idx, date, {_FWIS} from (select *, {_LAGS}, first_value(date) over (w rows between 6 preceding and current row) as d0,
      count(*) over (w rows between 6 preceding and current row) as n
      from scored window w as (partition by zone_idx order by date)) q where n=7 and date_diff('day', d0, date)=6""",
)
def w4_refreshed(spark, sf):
    """Windows that were built once and then followed a refresh: of the last
    eleven days' weather only the windows that reach into them are built again."""

    def run():
        base = scratch_dir(spark, "window_refresh")
        weather = V.weather_now(spark, sf)
        hot = X.detections(spark, sf)
        zones = refresh.ZoneRefresh(base, X.REGION, hot.schema, weather.schema, V.ndvi_obs(spark, sf))
        table = windows.window_table(f"{base}/windows")
        late = F.dayofmonth("date") > 20
        zones.land("detections", hot, 0)
        zones.on_weather(weather.withColumn("temperature_c", F.when(late, 20.0).otherwise(F.col("temperature_c"))), 0)
        windows.refresh_windows(spark, zones.state, table, TRAINING_FEATURES)
        zones.on_weather(weather.where(late), 1)
        windows.refresh_windows(spark, zones.state, table, TRAINING_FEATURES)
        return table

    rows = once(spark, sf, "refreshed windows", run).read(spark)
    return rows.select("zone_idx", "date", *[F.round(F.col("sequence")[i][_FWI], 4).alias(f"fwi_{i}") for i in range(7)])


@query("refresh_from_files", "select date, zone_idx, severity, reason from alert_rows_of_files")
def refresh_from_files(spark, sf):
    """Landed files of both sensors, one of them an error answer, and landed
    weather answers, to alerts."""
    hot, weather = V.hotspots(spark, sf), V.weather_now(spark, sf)
    newer, older, answers = (scratch_dir(spark, name) for name in ("newer_csv", "older_csv", "answers"))
    write_table(hot.where("event_id % 2 = 0").select(*schemas.HOTSPOT.names), newer, fmt="csv")
    renamed = hot.where("event_id % 2 = 1").withColumnRenamed("bright_ti4", "brightness")
    write_table(renamed.select(*schemas.HOTSPOT_MODIS.names), older, fmt="csv")
    spark.range(1).select(F.lit("Invalid MAP_KEY.").alias("value")).write.mode("append").text(newer)
    payload = F.to_json(
        F.struct(
            F.struct(F.col("temperature_c").alias("temp"), F.col("humidity_pct").alias("humidity"), F.lit(1010.0).alias("pressure")).alias("main"),
            F.struct(F.col("wind_speed_ms").alias("speed"), F.col("wind_deg").alias("deg")).alias("wind"),
            F.struct(F.col("precipitation_mm").alias("1h")).alias("rain"),
            F.struct(F.col("clouds_pct").alias("all")).alias("clouds"),
        )
    )
    stamp = F.col("date").cast("timestamp").alias("fetched_at")
    weather.select("latitude", "longitude", payload.alias("payload"), stamp).write.json(answers)

    sensors = [R.read_hotspots(spark, newer), R.read_hotspots(spark, older, schema=schemas.HOTSPOT_MODIS)]
    detections = daily.of_landed_hotspots(stitch(sensors))
    points = daily.of_landed_weather(R.read_weather_json(spark, answers))
    rows = daily.daily_alerts(detections, points, X.REGION, observed_ndvi=V.ndvi_obs(spark, sf))
    return rows.select("date", "zone_idx", "severity", "reason")
