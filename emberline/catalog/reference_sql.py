"""Plain SQL for the checking engine: brute force where the library is clever.

``sql(body)`` puts the named steps a body refers to in front of it.
"""

from __future__ import annotations

import re

from emberline.catalog.views import TEXT, duckdb_text

STEPS: dict[str, str] = {name: duckdb_text(name) for name in TEXT}

STEPS["zone_grid"] = """
select cast(r as int) as zone_idx, concat('G-', r) as zone_id, cast(r//35 as int) as row, cast(r%35 as int) as col,
  11.5e0+(r//35)*0.1e0+0.05e0 as latitude, 74.0e0+(r%35)*0.1e0+0.05e0 as longitude
from range(1400) t(r)"""

RADIUS = "0.1e0*0.75e0"

# Nearest station of the day for every zone, by comparing all of them.
STEPS["matched"] = """
select date, zone_idx, sqrt(min(d2)) as wx_distance_deg,
  arg_min({'temp': temp, 'rhum': rhum, 'wspd': wspd, 'prcp': prcp, 'station_id': station_id},
          {'d2': d2, 'id': station_id}) as b
from (select w.*, z.zone_idx,
    (z.latitude-w.latitude)*(z.latitude-w.latitude)+(z.longitude-w.longitude)*(z.longitude-w.longitude) as d2
  from zone_grid z cross join weather_daily w) p
group by date, zone_idx"""
STEPS["fire_pairs"] = f"""
select h.date, z.zone_idx, h.event_id, h.frp, h.confidence, h.bright_ti4 as brightness,
  (z.latitude-h.latitude)*(z.latitude-h.latitude)+(z.longitude-h.longitude)*(z.longitude-h.longitude) as d2
from zone_grid z join hotspots h on sqrt(
  (z.latitude-h.latitude)*(z.latitude-h.latitude)+(z.longitude-h.longitude)*(z.longitude-h.longitude)) <= {RADIUS}"""
STEPS["fire_best"] = """
select date, zone_idx, sqrt(min(d2)) as fire_distance_deg,
  arg_min({'frp': frp, 'confidence': confidence, 'brightness': brightness}, {'d2': d2, 'id': event_id}) as f
from fire_pairs group by date, zone_idx"""
STEPS["matched_now"] = """
select date, zone_idx, sqrt(min(d2)) as wx_distance_deg,
  arg_min({'t': temperature_c, 'h': humidity_pct, 'w': wind_speed_ms, 'd': wind_deg, 'p': precipitation_mm,
           'c': clouds_pct}, {'d2': d2, 'id': station_id}) as b
from (select w.*, z.zone_idx,
    (z.latitude-w.latitude)*(z.latitude-w.latitude)+(z.longitude-w.longitude)*(z.longitude-w.longitude) as d2
  from zone_grid z cross join weather_now w) p
group by date, zone_idx"""
STEPS["unified"] = """
select m.date, z.zone_idx, z.zone_id, z.row, z.col, z.latitude, z.longitude,
  b.t as wx_temperature_c, b.h as wx_humidity_pct, b.w as wx_wind_speed_ms, b.d as wx_wind_deg,
  b.p as wx_precipitation_mm, b.c as wx_clouds_pct, wx_distance_deg,
  f.frp as fire_frp, f.confidence as fire_confidence, f.brightness as fire_brightness, fire_distance_deg,
  fire_distance_deg is not null as active_fire_nearby
from matched_now m join zone_grid z using (zone_idx) left join fire_best using (date, zone_idx)"""
STEPS["live_clean"] = """
select u.* exclude (wx_temperature_c, wx_humidity_pct, wx_wind_speed_ms, wx_precipitation_mm, fire_frp),
  coalesce(u.wx_temperature_c, m.t) as wx_temperature_c, coalesce(u.wx_humidity_pct, m.h) as wx_humidity_pct,
  coalesce(u.wx_wind_speed_ms, m.w) as wx_wind_speed_ms, coalesce(u.wx_precipitation_mm, m.p) as wx_precipitation_mm,
  coalesce(u.fire_frp, 0e0) as fire_frp, month(u.date) as mon
from unified u join (select date, median(wx_temperature_c) as t, median(wx_humidity_pct) as h,
  median(wx_wind_speed_ms) as w, median(wx_precipitation_mm) as p from unified group by date) m using (date)"""
STEPS["history_clean"] = """
select date, zone_idx, coalesce(b.temp, m.t) as wx_temperature_c, coalesce(b.rhum, m.h) as wx_humidity_pct,
  coalesce(b.wspd, 0e0)/3.6e0 as wx_wind_speed_ms, coalesce(b.prcp, 0e0) as wx_precipitation_mm, month(date) as mon
from matched join (select date, median(b.temp) as t, median(b.rhum) as h from matched group by date) m using (date)"""
STEPS["station_clean"] = """
select station_id, date, temp as wx_temperature_c, rhum as wx_humidity_pct, wspd/3.6e0 as wx_wind_speed_ms,
  prcp as wx_precipitation_mm, month(date) as mon from weather_daily"""


def _case_month(values: list[float]) -> str:
    return "case mon " + " ".join(f"when {i} then {v}e0" for i, v in enumerate(values, 1)) + " end"


def _clip(x: str, lo=None, hi=None) -> str:
    low = f"when {x}<{lo} then {lo}e0 " if lo is not None else ""
    high = f"when {x}>{hi} then {hi}e0 " if hi is not None else ""
    return f"case {low}{high}else {x} end"


def _index_steps(src: str, out: str) -> None:
    """The five indices as a chain of steps ending in ``out``."""
    T, H, W, R = "wx_temperature_c", "wx_humidity_pct", "(wx_wind_speed_ms*3.6e0)", "wx_precipitation_mm"
    # Day-length factors of the twelve months.
    le = _case_month([6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0])
    lf = _case_month([-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6])
    chain = [
        f"""select *, 147.2e0*(101-85e0)/(59.5e0+85e0) as m00, {R}-0.5e0 as wet,
  0.18e0*(21.1e0-{T})*(1-exp(-0.115e0*{H})) as heat,
  0.424e0*(1-pow({H}/100, 1.7e0))+0.0694e0*sqrt({W})*(1-pow({H}/100, 8e0)) as kd,
  1.894e0*({T}+1.1e0)*(100-{H})*({le})*1e-4 as rk0, 0.36e0*({T}+2.8e0)+({lf}) as v0,
  {R}-1.27e0 as ex, 100/(0.5e0+0.3e0*6e0) as b, 800*exp(-15e0/400)+3.937e0*(0.83e0*{R}-1.27e0) as q0
from {src}""",
        f"""select *, case when {R}>0.5e0 then m00+42.5e0*wet*exp(-100e0/(251-m00))*(1-exp(-6.93e0/(case when wet<1e-6 then 1e-6 else wet end)))
    when {R} is not null then m00 end as m01,
  0.942e0*pow({H}, 0.679e0)+11*exp(({H}-100)/10)+heat as ed, 0.618e0*pow({H}, 0.753e0)+10*exp(({H}-100)/10)+heat as ew,
  kd*0.581e0*exp(0.0365e0*{T}) as kw, {_clip("rk0", lo=0)} as rk, {_clip("v0", lo=0)} as v,
  6e0+1000*ex/(48.77e0+b*(case when ex<1e-6 then 1e-6 else ex end)) as mr,
  400*ln(800/(case when q0<1e-6 then 1e-6 else q0 end)) as dr
from @0""",
        f"""select *, {_clip("m01", 0, 250)} as m0 from @1""",
        f"""select *, case when m0>ed then ed+(m0-ed)*pow(10e0, -kd) when m0<ew then ew-(ew-m0)*pow(10e0, -kw)
    when ed is not null and ew is not null then m0 end as m,
  case when {R}>1.5e0 then ({_clip("mr", lo=0)})+rk when {R} is not null then 6e0+rk end as dmc0,
  case when {R}>2.8e0 then ({_clip("dr", lo=0)}) when {R} is not null then 15e0 end + 0.5e0*v as dc0
from @2""",
        """select *, 59.5e0*(250-m)/(147.2e0+m) as ff0, case when dmc0<0 then 0e0 else dmc0 end as dmc,
  case when dc0<0 then 0e0 else dc0 end as dc from @3""",
        f"""select *, {_clip("ff0", 0, 101)} as ffmc, case when dmc+0.4e0*dc<1e-6 then 1e-6 else dmc+0.4e0*dc end as den from @4""",
        """select *, case when dmc<=0.4e0*dc then 0.8e0*dmc*dc/den
    else dmc-(1-0.8e0*dc/den)*(0.92e0+pow(0.0114e0*dmc, 1.7e0)) end as bui0,
  91.9e0*exp(-0.1386e0*(101-ffmc))*(1+pow(101-ffmc, 5.31e0)/4.93e7)*exp(0.05039e0*(wx_wind_speed_ms*3.6e0)) as isi from @5""",
        """select *, case when bui0<0 then 0e0 else bui0 end as bui from @6""",
        """select *, 0.1e0*isi*(case when bui<=80 then 0.626e0*pow(bui, 0.809e0)+2
    else 1000/(25+108.64e0*exp(-0.023e0*bui)) end) as fb from @7""",
        """select * exclude (m00, wet, heat, kd, rk0, v0, ex, b, q0, m01, ed, ew, kw, rk, v, mr, dr, m0, m, dmc0, dc0,
    ff0, den, bui0, isi, fb),
  case when fb<=1 then (case when fb<0 then 0e0 else fb end) else exp(2.72e0*pow(0.434e0*ln(fb), 0.647e0)) end as fwi
from @8""",
    ]
    for i, text in enumerate(chain):
        name = out if i == len(chain) - 1 else f"{out}_{i}"
        STEPS[name] = re.sub(r"@(\d)", lambda m: f"{out}_{m.group(1)}", text)


_index_steps("station_clean", "station_indices")
_index_steps("history_clean", "history_indices")
_index_steps("live_clean", "live_indices")

_DAYS = "date_diff('day', DATE '1970-01-01', i.date)"


def _unit(a: int, b: int) -> str:
    return f"((i.zone_idx*{a}+{_DAYS}*{b})%1000)/1000.0e0"


_BASE = f"(0.35e0+0.4e0*({_unit(7919, 104729)}))"
_BURNT = f"({_BASE}*(0.2e0+0.3e0*({_unit(31, 17)})))"


def _ndvi(active: str) -> str:
    v = f"(case when {active} then {_BURNT} else {_BASE} end)"
    wet = f"(case when {v}*1.1e0>0.9e0 then 0.9e0 else {v}*1.1e0 end)"
    return f"coalesce(o.ndvi, case when i.wx_precipitation_mm>1.0e0 then {wet} else {v} end)"


STEPS["labels_by_day"] = "select distinct date, zone_idx from fire_pairs"
STEPS["training"] = f"""
select i.* exclude (mon), z.zone_id, z.row, z.col, z.latitude, z.longitude,
  {_ndvi("false")} as ndvi, case when l.zone_idx is null then 0 else 1 end as fire_risk_label
from history_indices i join zone_grid z using (zone_idx)
  left join ndvi_obs o on o.date=i.date and o.zone_idx=i.zone_idx
  left join labels_by_day l on l.date=i.date and l.zone_idx=i.zone_idx"""
STEPS["processed"] = f"""
select i.* exclude (mon), {_ndvi("i.active_fire_nearby")} as ndvi,
  cast(i.active_fire_nearby or i.fwi>60 as int) as fire_risk_label
from live_indices i left join ndvi_obs o on o.date=i.date and o.zone_idx=i.zone_idx"""
STEPS["scored"] = """
select *, case when fwi/100<0 then 0e0 when fwi/100>1 then 1e0 else fwi/100 end as risk_score from processed"""
STEPS["banded"] = """
select *, case when risk_score>=0.9 then 'EXTREME' when risk_score>=0.7 then 'HIGH' when risk_score>=0.4 then 'MODERATE'
  when risk_score is not null then 'LOW' end as severity from scored"""


def one_decimal(x: str) -> str:
    tenths = f"cast(floor(round({x},4)*10+0.5) as bigint)"
    return f"concat({tenths}//10, '.', {tenths}%10)"


STEPS["alert_rows"] = f"""
select date, zone_idx, zone_id, latitude, longitude, risk_score, severity,
  case when why='' then 'elevated model risk score' else why end as reason
from (select *, concat_ws('; ', case when active_fire_nearby then 'active satellite hotspot nearby' end,
    case when fwi>60 then concat('extreme FWI (', {one_decimal("fwi")}, ')') end,
    case when wx_wind_speed_ms>8 then concat('high wind (', {one_decimal("wx_wind_speed_ms")}, ' m/s)') end) as why
  from banded where risk_score>=0.7) a"""
# The same chain over what is left of the weather once it has been landed as answers.
STEPS["weather_files"] = """
select cast(round(latitude*1000) as bigint)*1000000+cast(round(longitude*1000) as bigint) as station_id, date, latitude, longitude,
  temperature_c, humidity_pct, coalesce(wind_speed_ms, 0e0) as wind_speed_ms, coalesce(wind_deg, 0e0) as wind_deg,
  coalesce(precipitation_mm, 0e0) as precipitation_mm, coalesce(clouds_pct, 0e0) as clouds_pct
from weather_now where temperature_c is not null and humidity_pct is not null"""
_LIVE = [n for n in STEPS if n in ("matched_now", "unified", "live_clean", "processed", "scored", "banded", "alert_rows") or n.startswith("live_indices")]
for _name in _LIVE:
    STEPS[f"{_name}_of_files"] = re.sub(
        r"[a-z_0-9]+", lambda m: {"weather_now": "weather_files", **{n: f"{n}_of_files" for n in _LIVE}}.get(m.group(), m.group()), STEPS[_name]
    )
STEPS["latest_alerts"] = "select * from alert_rows where date=(select max(date) from scored)"
STEPS["cells"] = """
select *, case when ndvi<0.15 then 3 when risk_score>=0.7 then 1 else 0 end as state,
  case when ffmc/101<0 then 0e0 when ffmc/101>1 then 1e0 else ffmc/101 end as dryness,
  case when ndvi<0 then 0e0 when ndvi>1 then 1e0 else ndvi end as fuel from scored"""
STEPS["day_wind"] = """
select date, avg(wx_wind_speed_ms) as mean_wind_ms, avg(wx_wind_deg) as mean_wind_deg from scored group by date"""
# Row step, column step and bearing of the eight neighbours, written out here so that a wrong one in the library shows.
STEPS["offsets"] = """select * from (values (-1, 0, 0), (-1, 1, 45), (0, 1, 90), (1, 1, 135), (1, 0, 180), (1, -1, 225),
  (0, -1, 270), (-1, -1, 315)) o(d_row, d_col, bearing)"""
STEPS["edges"] = """
select c.date, c.zone_idx as from_zone, (c.row+d_row)*35+(c.col+d_col) as to_zone, bearing
from cells c cross join offsets where c.state=1 and c.row+d_row between 0 and 39 and c.col+d_col between 0 and 34"""


def alignment(bearing: str, wind_from: str) -> str:
    turn = f"abs({bearing}-(({wind_from}+180.0e0)%360.0e0))"
    f = f"(1.0e0+0.8e0*cos(radians(least({turn}, 360.0e0-{turn}))))"
    return f"(case when {f}<0.4e0 then 0.4e0 when {f}>1.8e0 then 1.8e0 else {f} end)"


def probability(dry: str, fuel: str, wind: str, aligned: str) -> str:
    boost = f"(1.0e0+case when {wind}/10.0e0>1 then 1e0 else {wind}/10.0e0 end)"
    p = f"(0.35e0*{dry}*{fuel}*{aligned}*{boost})"
    return f"(case when {p}<0 then 0e0 when {p}>0.97e0 then 0.97e0 else {p} end)"


STEPS["exposure"] = f"""
select e.date, e.to_zone as zone_idx, count(*) as burning_neighbours,
  1.0e0-exp(sum(ln(1.0e0-{probability("c.dryness", "c.fuel", "w.mean_wind_ms", alignment("e.bearing", "w.mean_wind_deg"))}))) as p_ignite
from edges e join cells c on c.date=e.date and c.zone_idx=e.to_zone join day_wind w on w.date=e.date
where c.state=0 group by 1, 2"""
STEPS["fire_cells"] = """
select * exclude (state), case when ndvi<0.15 then 3 when active_fire_nearby then 1 else 0 end as state from cells"""
STEPS["fire_edges"] = STEPS["edges"].replace("from cells", "from fire_cells")
STEPS["fire_exposure"] = STEPS["exposure"].replace("from edges", "from fire_edges").replace("join cells", "join fire_cells")
STEPS["day_summary"] = """
select date, count(*) as total_zones, count(*) filter (where risk_score>=0.7) as total_alerts,
  count(*) filter (where severity='EXTREME') as n_extreme, count(*) filter (where severity='HIGH') as n_high,
  0 as n_moderate, 0 as n_low, count(*) filter (where severity='MODERATE') as zones_moderate,
  count(*) filter (where severity='LOW') as zones_low, max(risk_score) as max_risk_score, avg(risk_score) as mean_risk_score
from banded group by date"""
# Three rule scores stand in for models, so that the metrics can be checked exactly.
STEPS["rule_scores"] = """
select 'fire_weather' as model, fire_risk_label as label, round(case when fwi/100>1 then 1e0 else fwi/100 end, 4) as score from training
union all
select 'dryness', fire_risk_label, round(ffmc/101, 4) from training
union all
select 'wind', fire_risk_label, round(wx_wind_speed_ms/12.0e0, 4) from training"""
STEPS["confusions"] = """
select model, count(*) filter (where label=0 and score<0.5) as tn, count(*) filter (where label=0 and score>=0.5) as fp,
  count(*) filter (where label=1 and score<0.5) as fn, count(*) filter (where label=1 and score>=0.5) as tp
from rule_scores group by model"""
STEPS["aucs"] = """
select model, sum(pos*(neg_below+0.5e0*neg))/(sum(pos)*sum(neg)) as auc_roc from (
  select model, score, pos, neg, coalesce(sum(neg) over (partition by model order by score rows between unbounded preceding and 1 preceding), 0) as neg_below
  from (select model, score, count(*) filter (where label=1) as pos, count(*) filter (where label=0) as neg
    from rule_scores group by model, score) g) h group by model"""
STEPS["metric_rows"] = """
select model, (tn+tp)/cast(tn+fp+fn+tp as double) as accuracy,
  case when tp+fp=0 then 0e0 else tp/cast(tp+fp as double) end as precision,
  case when tp+fn=0 then 0e0 else tp/cast(tp+fn as double) end as recall,
  case when 2*tp+fp+fn=0 then 0e0 else 2*tp/cast(2*tp+fp+fn as double) end as f1_score,
  auc_roc, case when fn+tp=0 then 0e0 else fn/cast(fn+tp as double) end as false_negative_rate
from confusions join aucs using (model)"""
STEPS["comparison"] = """
select model, round(accuracy, 4) as accuracy, round(precision, 4) as precision, round(recall, 4) as recall,
  round(f1_score, 4) as f1_score, round(auc_roc, 4) as auc_roc, round(false_negative_rate, 4) as false_negative_rate
from metric_rows"""
STEPS["metric_long"] = """
unpivot comparison on accuracy, precision, recall, f1_score, auc_roc, false_negative_rate into name metric value value"""

_WORD = re.compile(r"[a-z_0-9]+")


def sql(body: str) -> str:
    """``with`` the steps that a query needs, in order of definition."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for word in set(_WORD.findall(todo.pop())) & STEPS.keys() - need:
            need.add(word)
            todo.append(STEPS[word])
    order = [name for name in STEPS if name in need]
    parts = [f"{name} as materialized ({STEPS[name].strip()})" for name in _sorted(order)]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def _sorted(names: list[str]) -> list[str]:
    """Steps after those they refer to."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for word in _WORD.findall(STEPS[name]):
            if word in STEPS and word != name:
                visit(word)
        done.append(name)

    for name in names:
        visit(name)
    return done
