"""Explicit schemas; no source is ever inferred."""

from pyspark.sql import types as T


_TYPES = {
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from "name TYPE, ..." without needing a session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


HOTSPOT = _struct(
    "latitude DOUBLE, longitude DOUBLE, bright_ti4 DOUBLE, scan DOUBLE, track DOUBLE, "
    "acq_date DATE, acq_time INT, satellite STRING, confidence STRING, version STRING, "
    "bright_t31 DOUBLE, frp DOUBLE, daynight STRING"
)
# The older sensor names its brightness differently.
HOTSPOT_MODIS = _struct(
    "latitude DOUBLE, longitude DOUBLE, brightness DOUBLE, scan DOUBLE, track DOUBLE, "
    "acq_date DATE, acq_time INT, satellite STRING, confidence STRING, version STRING, "
    "bright_t31 DOUBLE, frp DOUBLE, daynight STRING"
)
HOTSPOT_HIST = T.StructType(list(HOTSPOT) + [T.StructField("fire_season_year", T.IntegerType())])

WEATHER_PAYLOAD = (
    "main STRUCT<temp: DOUBLE, humidity: DOUBLE, pressure: DOUBLE>, "
    "wind STRUCT<speed: DOUBLE, deg: DOUBLE>, rain STRUCT<`1h`: DOUBLE>, "
    "clouds STRUCT<all: DOUBLE>, weather ARRAY<STRUCT<main: STRING>>"
)
# Answers may carry the time at which they were fetched.
WEATHER_LANDED = _struct("latitude DOUBLE, longitude DOUBLE, payload STRING, fetched_at TIMESTAMP")
WEATHER_POINT = _struct(
    "latitude DOUBLE, longitude DOUBLE, temperature_c DOUBLE, humidity_pct DOUBLE, "
    "pressure_hpa DOUBLE, wind_speed_ms DOUBLE, wind_deg DOUBLE, precipitation_mm DOUBLE, "
    "clouds_pct DOUBLE, weather_main STRING"
)
WEATHER_DAILY = _struct(
    "date DATE, temp DOUBLE, rhum DOUBLE, prcp DOUBLE, wspd DOUBLE, wdir DOUBLE, "
    "pres DOUBLE, latitude DOUBLE, longitude DOUBLE, station_id STRING"
)
TRAINING_SET = _struct(
    "zone_id STRING, date DATE, latitude DOUBLE, longitude DOUBLE, wx_temperature_c DOUBLE, "
    "wx_humidity_pct DOUBLE, wx_wind_speed_ms DOUBLE, wx_precipitation_mm DOUBLE, ffmc DOUBLE, "
    "dmc DOUBLE, dc DOUBLE, bui DOUBLE, fwi DOUBLE, ndvi DOUBLE, fire_risk_label INT"
)

# Feature vectors of the observed-label and of the live models.
TRAINING_FEATURES = [
    "wx_temperature_c",
    "wx_humidity_pct",
    "wx_wind_speed_ms",
    "wx_precipitation_mm",
    "ffmc",
    "dmc",
    "dc",
    "bui",
    "fwi",
    "ndvi",
]
LIVE_FEATURES = TRAINING_FEATURES + ["fire_frp", "active_fire_nearby"]
