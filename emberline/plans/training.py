"""The observed-label training set: weather of each zone-day, and whether it burned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.functions.indices import with_indices
from emberline.functions.scalar import kmh_to_ms
from emberline.operators.features import impute_median, with_ndvi
from emberline.operators.grid import spine, with_zone_columns
from emberline.operators.nearest import nearest, zones_touched
from emberline.schemas import TRAINING_SET
from emberline.spec import RegionSpec

STATION_VALUES = ["temp", "rhum", "wspd", "prcp"]


def matched_weather(weather: DataFrame, region: RegionSpec, values=tuple(STATION_VALUES)) -> DataFrame:
    """The nearest station's values of the day for every zone and weather date."""
    zones = spine(weather.select("date").distinct(), region)
    return nearest(zones, weather, region, [*values, "station_id"], "wx", "station_id")


def cleaned(matched: DataFrame) -> DataFrame:
    """Station columns to features: medians for gaps in temperature and humidity,
    zero for gaps in wind and rain, wind in metres per second."""
    df = impute_median(matched, ["wx_temp", "wx_rhum"])
    return df.select(
        "date",
        "zone_idx",
        F.col("wx_temp").alias("wx_temperature_c"),
        F.col("wx_rhum").alias("wx_humidity_pct"),
        kmh_to_ms(F.coalesce("wx_wspd", F.lit(0.0))).alias("wx_wind_speed_ms"),
        F.coalesce("wx_prcp", F.lit(0.0)).alias("wx_precipitation_mm"),
    )


def fire_labels(zone_days: DataFrame, fires: DataFrame, region: RegionSpec) -> DataFrame:
    """Adds fire_risk_label: 1 where a detection of that day lies in reach."""
    burned = zones_touched(fires, region).withColumn("_hit", F.lit(1))
    return zone_days.join(burned, ["date", "zone_idx"], "left").withColumn(
        "fire_risk_label", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")


def indexed(weather: DataFrame, region: RegionSpec) -> DataFrame:
    """Zone-days with features and all five indices, without label."""
    return with_indices(cleaned(matched_weather(weather, region)), month=F.month("date"))


def training_rows(
    weather: DataFrame, fires: DataFrame, region: RegionSpec, observed_ndvi: DataFrame | None = None
) -> DataFrame:
    """Training set with ``zone_idx``. The greenness proxy never sees the label."""
    df = with_ndvi(indexed(weather, region), observed_ndvi, F.lit(False))
    return with_zone_columns(fire_labels(df, fires, region), region, centre=True)


def training_set(*args, **kwargs) -> DataFrame:
    """Training set in its published column order."""
    return training_rows(*args, **kwargs).select(*TRAINING_SET.names)


# Fixed value: first day of the held-out season.
TEST_START = "2025-01-01"


def temporal_split(df: DataFrame, test_start: str = TEST_START) -> tuple[DataFrame, DataFrame]:
    """(train, test) before and from a day; both filters reach the file scan."""
    day = F.lit(test_start).cast("date")
    train, test = df.where(F.col("date") < day), df.where(F.col("date") >= day)
    if "season_year" in df.columns:
        year = int(test_start[:4])
        train, test = train.where(F.col("season_year") <= year), test.where(F.col("season_year") >= year)
    return train, test


def with_split(df: DataFrame, test_start: str = TEST_START) -> DataFrame:
    """The same split as a column, for one pass over both sides."""
    return df.withColumn(
        "split", F.when(F.col("date") < F.lit(test_start).cast("date"), "train").otherwise("test")
    )
