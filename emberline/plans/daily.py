"""From detections and weather to scored zone-days and alerts, one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.indices import with_indices
from emberline.functions.scalar import brightness
from emberline.operators import alerts as A
from emberline.operators import features as X
from emberline.operators.grid import spine, with_zone_columns
from emberline.operators.learn import risk_scores
from emberline.operators.nearest import grown, nearest, nearest_within
from emberline.spec import AlertSpec, RegionSpec

LIVE_WEATHER = [
    "temperature_c",
    "humidity_pct",
    "wind_speed_ms",
    "wind_deg",
    "precipitation_mm",
    "clouds_pct",
]
FIRE_VALUES = ["frp", "confidence", "brightness"]


def of_landed_hotspots(hotspots: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Rows of ``read_hotspots``, of one sensor or several stitched, as
    ``unified`` takes them. The feed has no number: place and time make one."""
    place_and_time = F.xxhash64("latitude", "longitude", "acq_date", "acq_time")
    return hotspots.withColumns(
        {"date": F.col("acq_date"), "brightness": brightness(hotspots.columns), id_column: place_and_time}
    )


def of_landed_weather(weather: DataFrame, id_column: str = "station_id") -> DataFrame:
    """Rows of ``read_weather_json`` as ``unified`` takes them: the day of the
    fetch, and a number that follows from the place (thousandths of a degree)."""
    number = F.round(F.col("latitude") * 1000).cast("long") * 1_000_000 + F.round(F.col("longitude") * 1000).cast("long")
    return weather.withColumns({"date": F.to_date("fetched_at"), id_column: number})


def unified(
    hotspots: DataFrame,
    weather: DataFrame,
    region: RegionSpec,
    ingested_at: Column | None = None,
    hotspot_id: str = "event_id",
    station_id: str = "station_id",
) -> DataFrame:
    """Every zone of every weather date with its closest weather and detection.

    ``hotspots`` has date, latitude, longitude, frp, confidence, brightness and
    an id; ``weather`` has date, latitude, longitude, the six live values and
    an id. Both joins aggregate by (date, zone), so they share one partitioning
    and the left join between them moves nothing again.
    """
    zones = spine(weather.select("date").distinct(), region)
    wx = nearest(zones, weather, region, LIVE_WEATHER, "wx", station_id)
    fire = nearest_within(hotspots, region, FIRE_VALUES, "fire", hotspot_id)
    joined = wx.join(grown(fire), ["date", "zone_idx"], "left")
    return with_zone_columns(joined, region).withColumns(
        {
            "active_fire_nearby": F.col("fire_distance_deg").isNotNull(),
            "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at,
        }
    )


def processed(
    unified_rows: DataFrame, observed_ndvi: DataFrame | None = None, by: Sequence[str] = ("date",)
) -> DataFrame:
    """Imputed weather, moisture codes, indices, greenness and the rule label."""
    df = X.fill_defaults(X.impute_median(unified_rows, by=by))
    df = with_indices(df, month=F.month("date"))
    df = X.with_ndvi(df, observed_ndvi, F.col("active_fire_nearby"))
    return df.withColumn("fire_risk_label", X.rule_label(F.col("active_fire_nearby"), F.col("fwi")))


def scored(processed_rows: DataFrame, model=None) -> DataFrame:
    return risk_scores(processed_rows, model)


def daily_alerts(
    hotspots: DataFrame,
    weather: DataFrame,
    region: RegionSpec,
    alert_spec: AlertSpec = AlertSpec(),
    model=None,
    observed_ndvi: DataFrame | None = None,
    triggered_at: Column | None = None,
) -> DataFrame:
    """Which zones are at high risk on each day, and why."""
    rows = scored(processed(unified(hotspots, weather, region), observed_ndvi), model)
    return A.alerts(rows, alert_spec, triggered_at)
