"""Input views over the driver's tables.

Each text runs unchanged on both engines: braces name the tables, exponents
keep literals double, and only integer arithmetic, one division and
comparisons are used, so the inputs are bit-equal.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

LAT = "11.5e0+(({id}*7919)%4000)/1000.0e0"
LON = "74.0e0+(({id}*104729)%3500)/1000.0e0"


def _place(key: str) -> str:
    return f"{LAT.format(id=key)} as latitude, {LON.format(id=key)} as longitude"


TEXT = {
    "hotspots": f"""
select event_id, ts, cast(ts as date) as date, {_place("event_id")}, value as frp,
  case when event_id%10<2 then 'l' when event_id%10<7 then 'n' else 'h' end as confidence,
  300e0+(event_id%1000)/10.0e0 as bright_ti4, 0.3e0+(event_id%120)/100.0e0 as scan,
  0.3e0+(event_id%90)/100.0e0 as track, cast(ts as date) as acq_date,
  cast(hour(ts)*100+minute(ts) as int) as acq_time,
  case when event_id%3=0 then 'N' else '1' end as satellite, '2.0NRT' as version,
  280e0+(event_id%500)/10.0e0 as bright_t31,
  case when hour(ts) between 6 and 17 then 'D' else 'N' end as daynight
from {{events}} where event_type='error'""",
    # Two polls of every detection: each poll reads the whole last day again.
    "hotspots_repolled": """
select *, 1 as poll from {hotspots} union all select *, 2 as poll from {hotspots}""",
    "hotspots_hist": f"""
select o_orderkey as event_id, {_place("o_orderkey")}, o_totalprice/10000.0e0 as frp,
  cast(o_orderdate as date) as acq_date, cast(year(o_orderdate) as int) as fire_season_year
from {{orders}}""",
    "weather_daily": f"""
select user_id as station_id, cast(ts as date) as date, {_place("user_id")},
  max(case when event_id%17=0 then null else 22e0+(event_id*31%200)/10.0e0 end) as temp,
  max(case when event_id%13=0 then null else 8e0+(event_id*53%770)/10.0e0 end) as rhum,
  max((event_id*17%430)/10.0e0) as wspd, max(cast(event_id*29%360 as double)) as wdir,
  max(case when event_id%5=4 then (event_id*7%80)/10.0e0 when event_id%11=0 then null else 0e0 end) as prcp,
  max(1005e0+event_id%10) as pres, max(cast(event_id%100 as double)) as clouds
from {{events}} where event_type='view' group by 1,2,3,4""",
    "stations": f"""
select distinct user_id as station_id, {_place("user_id")} from {{events}}""",
    "hourly_obs": """
select user_id as station_id, ts, cast(ts as date) as date, 8e0+(event_id*53%770)/10.0e0 as rhum
from {events} where event_type='click'""",
    "weather_json": f"""
select event_id, {_place("event_id")},
  concat('{{{{', case when event_id%29=0 then '' else concat('"main":{{{{"temp":', 22+event_id%20,
    ',"humidity":', 8+event_id%77, ',"pressure":', 1005+event_id%10, '}}}},') end,
    case when event_id%4=0 then '' else concat('"wind":{{{{"speed":', event_id%12, ',"deg":', event_id%360, '}}}},') end,
    case when event_id%3=0 then concat('"rain":{{{{"1h":', event_id%5, '}}}},') else '' end,
    '"clouds":{{{{"all":', event_id%100, '}}}},"weather":',
    case when event_id%7=0 then '[]' else '[{{{{"main":"Clear"}}}}]' end, '}}}}') as payload
from {{events}} where event_type='signup'""",
    "ndvi_obs": """
select cast(floor(((event_id*7919)%4000)/100.0e0) as int)*35
    + cast(floor(((event_id*104729)%3500)/100.0e0) as int) as zone_idx,
  cast(ts as date) as date, min(0.05e0+0.7e0*((event_id*31%1000)/1000.0e0)) as ndvi
from {events} where event_type='purchase' group by 1,2""",
    "feed_answers": """
select event_id, event_type, case
    when event_type='error' then concat('Invalid MAP_KEY. ', props)
    when event_type='click' and value>50 then concat('HTTP ERROR 503 for request ', event_id)
    else concat('latitude,longitude,bright_ti4,scan,track,acq_date,acq_time ', event_id) end as body
from {events}""",
    "weather_now": """
select station_id, date, latitude, longitude, temp as temperature_c, rhum as humidity_pct,
  wspd/3.6e0 as wind_speed_ms, wdir as wind_deg, prcp as precipitation_mm, clouds as clouds_pct
from {weather_daily}""",
}

USES = {
    "hotspots_repolled": ["hotspots"],
    "weather_now": ["weather_daily"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    text = TEXT[name]
    sources = {}
    for base in ("events", "orders"):
        if "{" + base + "}" in text:
            sources[base] = table(spark, sf_dir, base)
    for other in USES.get(name, ()):
        sources[other] = view(spark, sf_dir, other)
    return spark.sql(text, **sources)


def duckdb_text(name: str) -> str:
    """The same view for the checking engine, where tables have their own names."""
    names = {k: k for k in ("events", "orders", *TEXT)}
    return TEXT[name].format(**names).strip()


hotspots = partial(view, name="hotspots")
hotspots_repolled = partial(view, name="hotspots_repolled")
hotspots_hist = partial(view, name="hotspots_hist")
weather_daily = partial(view, name="weather_daily")
weather_now = partial(view, name="weather_now")
stations = partial(view, name="stations")
hourly_obs = partial(view, name="hourly_obs")
weather_json = partial(view, name="weather_json")
ndvi_obs = partial(view, name="ndvi_obs")
feed_answers = partial(view, name="feed_answers")
