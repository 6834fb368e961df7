"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.catalog import views as V
from emberline.functions.scalar import brightness
from emberline.plans import daily, spread, state, training
from emberline.sources.writers import stored
from emberline.spec import RegionSpec

REGION = RegionSpec()
# The fixture holds one month; its last ten days play the held-out season.
TEST_START = "2024-01-21"


def detections(spark: SparkSession, sf: str) -> DataFrame:
    hot = V.hotspots(spark, sf)
    return hot.withColumn("brightness", brightness(hot.columns))


def training_rows(spark, sf) -> DataFrame:
    return training.training_rows(
        V.weather_daily(spark, sf), V.hotspots(spark, sf), REGION, V.ndvi_obs(spark, sf)
    )


def stored_training(spark, sf) -> DataFrame:
    """The training set as the stored table that model fitting reads."""
    return stored(training_rows(spark, sf), "training")


def unified(spark, sf) -> DataFrame:
    return daily.unified(detections(spark, sf), V.weather_now(spark, sf), REGION)


def processed(spark, sf) -> DataFrame:
    return daily.processed(unified(spark, sf), V.ndvi_obs(spark, sf))


def scored(spark, sf) -> DataFrame:
    return daily.scored(processed(spark, sf))


def alert_rows(spark, sf) -> DataFrame:
    from emberline.operators.alerts import alerts

    return alerts(scored(spark, sf)).drop("triggered_at")


def snapshot(spark, sf) -> DataFrame:
    """The scored zone-days as a stored snapshot, for queries that read them
    more than once."""
    return stored(scored(spark, sf), "snapshot")


def cells(spark, sf) -> DataFrame:
    return spread.alert_seeds(scored(spark, sf))


def summary(spark, sf) -> DataFrame:
    return state.summary(scored(spark, sf))


def rule_scores(spark, sf) -> DataFrame:
    """Labels with three rule scores, as (model, label, score, prediction)."""
    t = training_rows(spark, sf)
    fw = F.col("fwi") / 100
    models = F.array(
        F.struct(F.lit("fire_weather").alias("model"), F.round(F.when(fw > 1, F.lit(1.0)).otherwise(fw), 4).alias("score")),
        F.struct(F.lit("dryness").alias("model"), F.round(F.col("ffmc") / 101, 4).alias("score")),
        F.struct(F.lit("wind").alias("model"), F.round(F.col("wx_wind_speed_ms") / 12.0, 4).alias("score")),
    )
    long = t.select(F.col("fire_risk_label").alias("label"), F.explode(models).alias("m"))
    rows = long.select("m.model", "label", "m.score", (F.col("m.score") >= 0.5).cast("int").alias("prediction"))
    return stored(rows, "rule_scores")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to four places: the engines differ in the last bit of exp and pow.

    Greenness stays whole. It is plain arithmetic, hence bit-equal, and some of
    its values lie exactly between two roundings.
    """
    exact = ("ndvi", "fuel")
    kinds = [c for c, kind in df.dtypes if kind == "double" and c not in exact]
    return df.withColumns({c: F.round(c, digits) for c in kinds})
