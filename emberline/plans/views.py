"""The library's tables as temporary views, for queries in plain SQL.

Together with the functions of ``functions.sql`` they let a query say in SQL
what the plans say in DataFrames. Views are plans, not data: each query that
reads one is optimised as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions import sql
from emberline.plans import daily, training
from emberline.spec import RegionSpec


def register_history(spark: SparkSession, weather_daily: DataFrame, region: RegionSpec) -> None:
    """``zone_weather``: date, zone_idx, month and the four weather columns of
    every zone-day of the station history, without gaps."""
    sql.register(spark)
    rows = training.cleaned(training.matched_weather(weather_daily, region))
    rows.withColumn("month", F.month("date")).createOrReplaceTempView("zone_weather")


def register_live(spark: SparkSession, hotspots: DataFrame, weather: DataFrame, region: RegionSpec, observed_ndvi: DataFrame | None = None) -> None:
    """``zone_days``: every zone of every live weather date with its weather,
    detection, indices and greenness."""
    sql.register(spark)
    daily.processed(daily.unified(hotspots, weather, region), observed_ndvi).createOrReplaceTempView("zone_days")
