"""Joins, features, indices, alerts, spread and serving tables over zone-days."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog import frames as X
from emberline.catalog import views as V
from emberline.catalog.reference_sql import alignment, probability
from emberline.catalog.registry import query, r4
from emberline.functions import indices as I
from emberline.functions import spread as S
from emberline.functions.scalar import kmh_to_ms
from emberline.operators import adjacency as N
from emberline.operators import alerts as A
from emberline.operators import features as FT
from emberline.operators import stations as ST
from emberline.operators.grid import spine
from emberline.operators.nearest import nearest, nearest_within
from emberline.plans import daily, serving, spread, state, training
from emberline.plans import views as SQL
from emberline.schemas import LIVE_FEATURES
from emberline.spec import AlertSpec, SpreadSpec

ALERT, SPREAD = AlertSpec(), SpreadSpec()
WX = ["wx_temperature_c", "wx_humidity_pct", "wx_wind_speed_ms", "wx_precipitation_mm"]


# -- joins ---------------------------------------------------------------------


@query(
    "j1_nearest_join",
    """select date, zone_idx, b.t as wx_temperature_c, b.h as wx_humidity_pct, round(b.w, 4) as wx_wind_speed_ms,
    b.d as wx_wind_deg, b.p as wx_precipitation_mm, b.c as wx_clouds_pct, round(wx_distance_deg, 4) as wx_distance_deg
    from matched_now""",
)
def j1(spark, sf):
    """Closest weather point of every zone, whatever its distance."""
    weather = V.weather_now(spark, sf)
    zones = spine(weather.select("date").distinct(), X.REGION)
    return X.rounded(nearest(zones, weather, X.REGION, daily.LIVE_WEATHER, "wx", "station_id"))


@query(
    "j2_bounded_nearest_join",
    """select date, zone_idx, round(f.frp, 4) as fire_frp, f.confidence as fire_confidence, round(f.brightness, 4) as fire_brightness,
    round(fire_distance_deg, 4) as fire_distance_deg from fire_best""",
)
def j2(spark, sf):
    """Closest detection within the match radius."""
    return X.rounded(nearest_within(X.detections(spark, sf), X.REGION, daily.FIRE_VALUES, "fire", "event_id"))


@query(
    "j3_nearest_join_by_date",
    """select date, zone_idx, b.temp as wx_temp, b.rhum as wx_rhum, b.wspd as wx_wspd, b.prcp as wx_prcp,
    b.station_id as wx_station_id, round(wx_distance_deg, 4) as wx_distance_deg from matched""",
)
def j3(spark, sf):
    """The day's closest station for every zone and date."""
    return X.rounded(training.matched_weather(V.weather_daily(spark, sf), X.REGION))


@query("j4_fire_label", "select date, zone_idx, fire_risk_label from training")
def j4(spark, sf):
    """Label of every zone-day by detections of the same day in reach."""
    zones = spine(V.weather_daily(spark, sf).select("date").distinct(), X.REGION)
    return training.fire_labels(zones, V.hotspots(spark, sf), X.REGION)


# Ten ranges of three days and the last day: short enough that stations have gaps, and all days are read.
RANGES = [(f"from {day:02d}", f"2024-01-{day:02d}", f"2024-01-{min(day + 2, 31):02d}") for day in range(1, 32, 3)]
_RANGES_SQL = "(values " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in RANGES) + ") r(season, s, e)"
_HAV = """6371.0e0*2*asin(sqrt(sin(radians(s.latitude-p.plat)/2)*sin(radians(s.latitude-p.plat)/2)
  + cos(radians(p.plat))*cos(radians(s.latitude))*sin(radians(s.longitude-p.plon)/2)*sin(radians(s.longitude-p.plon)/2)))"""
_NEAR = f"""(select * from (select point_idx, plat, plon, station_id, km,
    row_number() over (partition by point_idx order by round(km, 6), station_id) as rk
  from (select p.*, s.station_id, {_HAV} as km from (select cast(r as int) as point_idx, 11.5e0+(r//4)*(4.0e0/3) as plat,
      74.0e0+(r%4)*(3.5e0/3) as plon from range(16) t(r)) p cross join stations s) d where km<=150) k where rk<=8)"""
_CHOSEN = f"""(select season, point_idx, plat, plon, arg_min(n.station_id, rk) as station_id, min(rk) as rk from {_NEAR} n
  join (select distinct season, station_id from weather_daily w join {_RANGES_SQL} on w.date between r.s and r.e) a
    on a.station_id=n.station_id group by 1, 2, 3, 4)"""


@query(
    "j5_nearby_stations",
    f"select point_idx, station_id, rk as station_rank, round(km, 4) as distance_km from {_NEAR} n",
)
def j5_near(spark, sf):
    """The eight nearest stations within 150 km of each lattice point."""
    near = ST.stations_near_lattice(V.stations(spark, sf), X.REGION)
    return X.rounded(near.select("point_idx", "station_id", "station_rank", "distance_km"))


@query(
    "j5_station_fallback",
    f"""select c.season, c.point_idx, c.station_id, c.rk as station_rank, w.date, round(c.plat, 4) as latitude,
    round(c.plon, 4) as longitude, w.temp, w.rhum, w.prcp, w.wspd from {_CHOSEN} c join {_RANGES_SQL} on r.season=c.season
    join weather_daily w on w.station_id=c.station_id and w.date between r.s and r.e""",
)
def j5(spark, sf):
    """Per season the nearest of eight stations that has rows supplies a point."""
    near = ST.stations_near_lattice(V.stations(spark, sf), X.REGION)
    rows = ST.point_weather(near, V.weather_daily(spark, sf), RANGES)
    return X.rounded(
        rows.select(
            "season", "point_idx", "station_id", "station_rank", "date", "latitude", "longitude", "temp", "rhum", "prcp", "wspd"
        )
    )


@query(
    "j6_source_merge",
    """select station_id, date, w.temp, round(coalesce(w.rhum, h.rhum), 4) as rhum, w.wspd, w.prcp from weather_daily w
    full join (select station_id, date, avg(rhum) as rhum from hourly_obs group by 1, 2) h using (station_id, date)""",
)
def j6(spark, sf):
    """Daily humidity completed from hourly observations."""
    merged = ST.merge_sources(V.weather_daily(spark, sf), V.hourly_obs(spark, sf))
    return merged.select("station_id", "date", "temp", F.round("rhum", 4).alias("rhum"), "wspd", "prcp")


@query("j7_neighbour_join", "select date, from_zone, to_zone, bearing from edges")
def j7(spark, sf):
    """Burning cells to their neighbours on the grid."""
    burning = X.cells(spark, sf).where(F.col("state") == S.BURNING)
    return N.neighbour_edges(burning, X.REGION)


@query(
    "j9_alert_membership",
    """select p.date, p.zone_idx, a.zone_idx is not null as alerting from processed p left join
    (select distinct date, zone_idx from alert_rows where severity in ('HIGH','EXTREME')) a on a.date=p.date and a.zone_idx=p.zone_idx""",
)
def j9(spark, sf):
    """Which zones are on the alert list."""
    rows = X.snapshot(spark, sf)
    hot = A.alerting_zones(A.alerts(rows)).select("date", "zone_idx").withColumn("_a", F.lit(True))
    return rows.join(hot, ["date", "zone_idx"], "left").select(
        "date", "zone_idx", F.coalesce("_a", F.lit(False)).alias("alerting")
    )


# -- cleaning and indices ------------------------------------------------------


@query(
    "p4_active_flag",
    "select date, zone_idx, active_fire_nearby, round(fire_distance_deg, 4) as fire_distance_deg from unified",
)
def p4(spark, sf):
    return X.rounded(X.unified(spark, sf).select("date", "zone_idx", "active_fire_nearby", "fire_distance_deg"))


@query(
    "p6_default_fills",
    "select date, zone_idx, round(coalesce(fire_frp, 0e0), 4) as fire_frp, active_fire_nearby from unified",
)
def p6(spark, sf):
    filled = FT.fill_defaults(X.unified(spark, sf))
    return X.rounded(filled.select("date", "zone_idx", "fire_frp", "active_fire_nearby"))


def station_weather(spark, sf):
    return V.weather_daily(spark, sf).select(
        "station_id",
        "date",
        F.col("temp").alias(WX[0]),
        F.col("rhum").alias(WX[1]),
        kmh_to_ms("wspd").alias(WX[2]),
        F.col("prcp").alias(WX[3]),
    )


def _station_index(name: str, key: str):
    @query(key, f"select station_id, date, {r4(name)} from station_indices")
    def run(spark, sf):
        rows = I.with_indices(station_weather(spark, sf), month=F.month("date"))
        return rows.select("station_id", "date", F.round(name, 4).alias(name))

    return run


for _key, _name in (("p7_ffmc", "ffmc"), ("p8_dmc", "dmc"), ("p9_dc", "dc"), ("p10_bui", "bui"), ("p11_fwi", "fwi")):
    _station_index(_name, _key)


@query(
    "p7_zone_indices",
    f"select date, zone_idx, {r4('ffmc', 'dmc', 'dc', 'bui', 'fwi')} from history_indices",
)
def p7_zones(spark, sf):
    """All five indices of every zone-day."""
    rows = training.indexed(V.weather_daily(spark, sf), X.REGION)
    return X.rounded(rows.select("date", "zone_idx", "ffmc", "dmc", "dc", "bui", "fwi"))


@query(
    "p7_sql_indices",
    f"select date, zone_idx, {r4('ffmc', 'dmc', 'dc', 'bui', 'fwi')} from history_indices",
)
def p7_sql(spark, sf):
    """The same indices as a query in plain SQL over a view, with SQL functions."""
    SQL.register_history(spark, V.weather_daily(spark, sf), X.REGION)
    return spark.sql(
        """
        with codes as (
            select date, zone_idx, wx_wind_speed_ms,
                ffmc(wx_temperature_c, wx_humidity_pct, wx_wind_speed_ms, wx_precipitation_mm) as ffmc,
                dmc(wx_temperature_c, wx_humidity_pct, wx_precipitation_mm, duff_day_length(month)) as dmc,
                dc(wx_temperature_c, wx_precipitation_mm, drought_day_length(month)) as dc
            from zone_weather
        ), built as (select *, bui(dmc, dc) as bui from codes)
        select date, zone_idx, round(ffmc, 4) as ffmc, round(dmc, 4) as dmc, round(dc, 4) as dc, round(bui, 4) as bui,
            round(fwi(ffmc, bui, wx_wind_speed_ms), 4) as fwi
        from built
        """
    )


@query("k1_sql_alerts", "select date, zone_idx, round(risk_score, 4) as risk_score, severity, reason from alert_rows")
def k1_sql(spark, sf):
    """Alerts as a query in plain SQL."""
    SQL.register_live(spark, X.detections(spark, sf), V.weather_now(spark, sf), X.REGION, V.ndvi_obs(spark, sf))
    return spark.sql(
        """
        select date, zone_idx, round(risk, 4) as risk_score, severity(risk) as severity,
            alert_reason(active_fire_nearby, fwi, wx_wind_speed_ms) as reason
        from (select *, fallback_risk(fwi) as risk from zone_days) where is_alert(risk)
        """
    )


@query("p12_ndvi", f"select date, zone_idx, {r4('ndvi')} from processed")
def p12(spark, sf):
    """Observed greenness, else the proxy."""
    return X.rounded(X.processed(spark, sf).select("date", "zone_idx", "ndvi"))


@query("p13_rule_label", "select date, zone_idx, fire_risk_label from processed")
def p13(spark, sf):
    return X.processed(spark, sf).select("date", "zone_idx", "fire_risk_label")


@query(
    "p14_feature_matrix",
    "select date, zone_idx, zone_id, "
    + r4(*LIVE_FEATURES[:-1])
    + ", cast(active_fire_nearby as int) as active_fire_nearby, fire_risk_label from processed",
)
def p14(spark, sf):
    return X.rounded(FT.feature_matrix(X.processed(spark, sf)))


@query("a1_median_imputation", f"select date, zone_idx, {r4(*WX)} from live_clean")
def a1(spark, sf):
    rows = FT.impute_median(X.unified(spark, sf))
    return X.rounded(rows.select("date", "zone_idx", *WX))


@query("a2_median_by_date", f"select date, zone_idx, {r4(*WX)} from history_clean")
def a2(spark, sf):
    return X.rounded(training.cleaned(training.matched_weather(V.weather_daily(spark, sf), X.REGION)))


# -- risk and alerts -----------------------------------------------------------


@query("p15_fallback_risk", f"select date, zone_idx, {r4('risk_score')} from scored")
def p15(spark, sf):
    return X.rounded(X.scored(spark, sf).select("date", "zone_idx", "risk_score"))


@query("p16_severity", "select date, zone_idx, severity from banded")
def p16(spark, sf):
    return X.scored(spark, sf).select("date", "zone_idx", A.severity("risk_score", ALERT).alias("severity"))


@query("p17_alert_filter", f"select date, zone_idx, {r4('risk_score')} from scored where risk_score>=0.7")
def p17(spark, sf):
    return X.rounded(X.alert_rows(spark, sf).select("date", "zone_idx", "risk_score"))


@query("p18_alert_reason", "select date, zone_idx, reason from alert_rows")
def p18(spark, sf):
    return X.alert_rows(spark, sf).select("date", "zone_idx", "reason")


_ALERT_COLUMNS = "date, zone_idx, zone_id, round(latitude, 4) as latitude, round(longitude, 4) as longitude, round(risk_score, 4) as risk_score, severity, reason"


@query("k1_ranked_alerts", f"select {_ALERT_COLUMNS} from alert_rows order by risk_score desc, date, zone_idx")
def k1(spark, sf):
    """All alerts, highest risk first. Scores are rounded before ranking so
    that the order is the same on every engine."""
    return A.ranked(X.rounded(X.alert_rows(spark, sf)))


def _top(k: int):
    @query(
        f"k2_top_{k}_alerts",
        f"select * from (select {_ALERT_COLUMNS} from alert_rows) a order by risk_score desc, date, zone_idx limit {k}",
    )
    def run(spark, sf):
        return A.top_alerts(X.rounded(X.alert_rows(spark, sf)), k)

    return run


for _k in (5, 10, 20):
    _top(_k)


@query(
    "k2_alert_remainder",
    "select count(*) as total_alerts, greatest(count(*)-20, 0) as more_alerts from alert_rows",
)
def k2_rest(spark, sf):
    return A.remainder(X.alert_rows(spark, sf), 20)


@query("u2_alerting_zones", "select distinct date, zone_idx, zone_id from alert_rows where severity in ('HIGH','EXTREME')")
def u2(spark, sf):
    return A.alerting_zones(X.alert_rows(spark, sf))


# -- spread --------------------------------------------------------------------


@query(
    "p19_spread_inputs",
    f"""select date, zone_idx, {r4('dryness', 'fuel')}, ndvi<0.15 as non_fuel, active_fire_nearby as ignition from cells""",
)
def p19(spark, sf):
    rows = spread.fire_seeds(X.processed(spark, sf))
    return X.rounded(rows.select("date", "zone_idx", "dryness", "fuel", "non_fuel", "ignition"))


@query(
    "p20_alert_ignition",
    "select date, zone_idx, risk_score>=0.7 as ignition from cells",
)
def p20(spark, sf):
    """Ignition of the zones named in the alert list."""
    state_rows = X.snapshot(spark, sf)
    rows = spread.member_seeds(state_rows, A.alerting_zones(A.alerts(state_rows)))
    return rows.select("date", "zone_idx", "ignition")


@query(
    "p21_wind_alignment",
    f"""select station_id, date, bearing, round({alignment("bearing", "wdir")}, 4) as alignment
    from weather_daily cross join (select bearing from offsets) o""",
)
def p21(spark, sf):
    bearings = F.array(*[F.lit(b) for _, _, b in S.NEIGHBOURS])
    rows = V.weather_daily(spark, sf).select("station_id", "date", "wdir", F.explode(bearings).alias("bearing"))
    aligned = S.wind_alignment("bearing", "wdir", SPREAD)
    return rows.select("station_id", "date", "bearing", F.round(aligned, 4).alias("alignment"))


@query(
    "p22_spread_probability",
    f"""select date, zone_idx, round({probability("dryness", "fuel", "wx_wind_speed_ms", alignment("90", "wx_wind_deg"))}, 4) as p
    from cells""",
)
def p22(spark, sf):
    """Chance that fire reaches a zone from the west under its own wind."""
    aligned = S.wind_alignment(F.lit(90), "wx_wind_deg", SPREAD)
    p = S.spread_probability("dryness", "fuel", "wx_wind_speed_ms", aligned, SPREAD)
    return X.cells(spark, sf).select("date", "zone_idx", F.round(p, 4).alias("p"))


@query("p23_initial_state", "select date, zone_idx, state from cells")
def p23(spark, sf):
    return X.cells(spark, sf).select("date", "zone_idx", "state")


@query(
    "a6_mean_wind",
    """select date, round(avg(wx_wind_speed_ms), 4) as mean_wind_ms, round(avg(wx_wind_deg), 4) as mean_wind_deg,
    round((degrees(atan2(avg(sin(radians(wx_wind_deg))), avg(cos(radians(wx_wind_deg)))))+360)%360, 4) as circular_wind_deg
    from scored group by date""",
)
def a6(spark, sf):
    return X.rounded(N.mean_wind(X.scored(spark, sf)))


@query(
    "a7_state_counts",
    """select date, count(*) filter (where state=0) as n_unburned, count(*) filter (where state=1) as n_burning,
    count(*) filter (where state=2) as n_burned, count(*) filter (where state=3) as n_non_fuel, 0e0 as burned_pct
    from cells group by date""",
)
def a7(spark, sf):
    return N.state_counts(X.cells(spark, sf))


@query(
    "a17_ignition_probability",
    "select date, zone_idx, burning_neighbours, round(p_ignite, 4) as p_ignite from exposure",
)
def a17(spark, sf):
    """One-step ignition probability of each exposed cell."""
    return X.rounded(spread.exposure(spread.alert_seeds(X.snapshot(spark, sf)), X.REGION))


@query(
    "x1_seed_cells",
    """select date, zone_idx, row, col, case when ndvi<0.15 then 3 when active_fire_nearby then 1 else 0 end as fire_state,
    state as alert_state from cells""",
)
def x1(spark, sf):
    """Cells seeded from active fires and from alerts."""
    rows = spread.fire_seeds(X.scored(spark, sf)).withColumnRenamed("state", "fire_state")
    hot = F.col("risk_score") >= ALERT.threshold
    return rows.select(
        "date", "zone_idx", "row", "col", "fire_state", S.initial_state(hot, "non_fuel").alias("alert_state")
    )


@query(
    "x2_spread_exposure",
    "select date, zone_idx, burning_neighbours, round(p_ignite, 4) as p_ignite from fire_exposure",
)
def x2(spark, sf):
    """Exposure of cells next to active fires."""
    return X.rounded(spread.exposure(spread.fire_seeds(X.snapshot(spark, sf)), X.REGION))


_STEP = """select c.date, 1 as step, 15 as minutes_elapsed, round(coalesce(e.s, 0e0), 4) as expected_new_burning,
    coalesce(e.n, 0) as n_exposed, c.n_burning as n_burning_out, c.n_burning as n_burned_after, c.n_non_fuel
    from (select date, count(*) filter (where state=1) as n_burning, count(*) filter (where state=3) as n_non_fuel from cells group by 1) c
    left join (select date, sum(p_ignite) as s, count(*) as n from exposure group by 1) e on e.date=c.date"""


@query("x3_next_step", _STEP)
def x3(spark, sf):
    """Counts after one spread step."""
    return X.rounded(spread.projection(spread.alert_seeds(X.snapshot(spark, sf)), X.REGION))


# -- summary and serving -------------------------------------------------------

_SUMMARY = """date, total_zones, total_alerts, n_extreme, n_high, n_moderate, n_low, zones_moderate, zones_low,
    round(max_risk_score, 4) as max_risk_score, round(mean_risk_score, 4) as mean_risk_score"""


@query("a5_state_summary", f"select {_SUMMARY} from day_summary")
def a5(spark, sf):
    return X.rounded(X.summary(spark, sf))


@query(
    "p24_marker_size",
    """select date, zone_idx, round(case when risk_score*22+4<4 then 4e0 when risk_score*22+4>26 then 26e0
    else risk_score*22+4 end, 4) as marker_size from scored""",
)
def p24(spark, sf):
    return X.rounded(X.scored(spark, sf).select("date", "zone_idx", serving.marker_size("risk_score").alias("marker_size")))


@query(
    "p25_peak_class",
    "select date, case when max_risk_score>0.7 then 'danger' when max_risk_score>0.4 then 'warn' else 'ok' end as peak_class from day_summary",
)
def p25(spark, sf):
    return X.summary(spark, sf).select("date", serving.peak_class("max_risk_score").alias("peak_class"))


@query(
    "v1_header_metrics",
    """select date, total_zones, total_alerts, n_extreme, n_high, round(max_risk_score, 4) as max_risk_score,
    case when max_risk_score>0.7 then 'danger' when max_risk_score>0.4 then 'warn' else 'ok' end as peak_class,
    case when total_alerts>0 then 'warn' else 'ok' end as alerts_class, case when n_extreme>0 then 'danger' else 'ok' end as extreme_class,
    case when n_high>0 then 'warn' else 'ok' end as high_class from day_summary""",
)
def v1(spark, sf):
    return X.rounded(serving.header_metrics(X.summary(spark, sf)))


@query(
    "v2_risk_map",
    """select date, zone_id, round(latitude, 4) as latitude, round(longitude, 4) as longitude, round(fwi, 4) as fwi,
    active_fire_nearby, round(risk_score, 4) as risk_score, round(case when risk_score*22+4>26 then 26e0
    else risk_score*22+4 end, 4) as marker_size from scored""",
)
def v2(spark, sf):
    return X.rounded(serving.risk_map(X.scored(spark, sf)))


@query(
    "v3_alert_list",
    f"""select *, (select greatest(count(*)-20, 0) from latest_alerts) as more_alerts from (select {_ALERT_COLUMNS} from latest_alerts) a
    order by risk_score desc, date, zone_idx limit 20""",
)
def v3(spark, sf):
    """The first alerts of the newest snapshot."""
    rows = serving.latest(X.snapshot(spark, sf))
    return serving.alert_list(X.rounded(A.alerts(rows).drop("triggered_at")))


@query(
    "v4_risk_gauge",
    """select date, round(mean_risk_score*100, 4) as mean_risk_pct, case when mean_risk_score*100<40 then '0-40'
    when mean_risk_score*100<70 then '40-70' else '70-100' end as gauge_zone, 70e0 as threshold_pct,
    mean_risk_score*100>=70 as above_threshold from day_summary""",
)
def v4(spark, sf):
    return X.rounded(serving.risk_gauge(X.summary(spark, sf)))


@query(
    "v6_run_summary",
    f"""select {_SUMMARY.replace("date,", "s.date,", 1)}, x.minutes_elapsed, x.expected_new_burning, x.n_burning_out, x.n_burned_after, coalesce(a.top_alerts, '') as top_alerts
    from day_summary s left join ({_STEP}) x on x.date=s.date
    left join (select date, string_agg(concat(severity, ' ', zone_id, ' ', reason), ' / ' order by n) as top_alerts
      from (select *, row_number() over (partition by date order by risk_score desc, zone_idx) as n from alert_rows) r where n<=10 group by 1) a
      on a.date=s.date""",
)
def v6(spark, sf):
    """Header numbers, spread projection and ten first alerts of each day."""
    rows = X.snapshot(spark, sf)
    projected = spread.projection(spread.alert_seeds(rows), X.REGION)
    out = serving.run_summary(state.summary(rows), projected, A.alerts(rows))
    return X.rounded(out).withColumn("top_alerts", F.array_join("top_alerts", " / "))
