"""Refresh of the stored zone state by micro-batches of detections and weather.

    detections/date=D/batch_id=N    what each batch of detections brought
    weather/date=D/batch_id=N       what each batch of weather brought
    zone_state/                     scored zone-days in versions (plans.versions)

A batch of either kind is landed under its own number first. Then the dates
that it touches are computed anew, from all landed detections and the newest
landed weather of each station, and make the next version of the state; all
other dates keep their files. A replayed batch lands the same files again, so
the state's rows are the same whatever the batches were. A batch without rows
writes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from emberline.operators.dedup import DETECTION_KEYS, first_detection
from emberline.operators.learn import load_or_none
from emberline.plans import daily
from emberline.plans.versions import VersionedDates
from emberline.sources.readers import folders_like
from emberline.spec import RegionSpec

INPUTS = ("detections", "weather")


def newest_weather(landed: DataFrame, station_id: str = "station_id") -> DataFrame:
    """Of each station and date the row of the newest landing."""
    rest = [c for c in landed.columns if c not in ("date", station_id, "batch_id")]
    newest = landed.groupBy("date", station_id).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_w"))
    return newest.select("date", station_id, "_w.*")


class ZoneRefresh:
    """``on_detections`` and ``on_weather`` are what
    ``streaming.detections.refresh_batches`` runs; both feeds may run in one
    driver at the same time.

    The schemas are those of the feeds, which have the columns that
    ``daily.unified`` takes. ``model_path`` is looked at in every refresh: a
    model saved there scores from then on, and without one the rule does.
    """

    def __init__(
        self,
        base: str,
        region: RegionSpec,
        detections: T.StructType,
        weather: T.StructType,
        observed_ndvi: DataFrame | None = None,
        model_path: str | None = None,
        key: Sequence[str] = DETECTION_KEYS,
        hotspot_id: str = "event_id",
        station_id: str = "station_id",
        refreshed_at: Column | None = None,
    ):
        self.base, self.region = base.rstrip("/"), region
        self.schemas = {"detections": detections, "weather": weather}
        self.observed_ndvi, self.model_path, self.key = observed_ndvi, model_path, key
        self.hotspot_id, self.station_id = hotspot_id, station_id
        self.refreshed_at = F.current_timestamp() if refreshed_at is None else refreshed_at
        self.state = VersionedDates(f"{self.base}/zone_state", INPUTS)
        self._one = Lock()

    def on_detections(self, batch: DataFrame, batch_id: int) -> None:
        self._on("detections", batch, batch_id)

    def on_weather(self, batch: DataFrame, batch_id: int) -> None:
        self._on("weather", batch, batch_id)

    def _on(self, kind: str, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with self._one:
            self.land(kind, batch, batch_id)
            touched = self.dates_of(spark, kind, batch_id)
            if touched:
                self.state.write(self.rows(spark, touched), {day: {kind: batch_id} for day in touched})

    def land(self, kind: str, batch: DataFrame, batch_id: int) -> None:
        """Stores a batch under its number; rows without a date have no zone-day."""
        rows = batch.select(*self.schemas[kind].names).where("date is not null")
        # A date goes to one task or, if it is large, to a few: files grow with the rows, not with tasks times dates.
        rows = rows.hint("rebalance", F.col("date"))
        writer = rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{self.base}/{kind}")

    def dates_of(self, spark: SparkSession, kind: str, batch_id: int) -> list[dt.date]:
        """The dates of a landed batch, by the names of its folders."""
        found = folders_like(spark, f"{self.base}/{kind}/date=*/batch_id={batch_id}")
        return sorted(dt.date.fromisoformat(p.split("/")[-2].removeprefix("date=")) for p in found)

    def landed(self, spark: SparkSession, kind: str, days: Sequence[dt.date]) -> DataFrame:
        """The landed rows of some dates with their ``batch_id``; only the
        folders of these dates are listed."""
        fields = [f for f in self.schemas[kind].fields if f.name != "date"]
        schema = T.StructType([*fields, T.StructField("date", T.DateType()), T.StructField("batch_id", T.LongType())])
        folder = f"{self.base}/{kind}"
        known = {p.rsplit("/", 1)[1] for p in folders_like(spark, f"{folder}/date=*")}
        there = [f"{folder}/date={d}" for d in days if f"date={d}" in known]
        return spark.read.schema(schema).option("basePath", folder).parquet(*there) if there else spark.createDataFrame([], schema)

    def rows(self, spark: SparkSession, days: Sequence[dt.date]) -> DataFrame:
        """The scored zone-days of some dates from all that has been landed."""
        hot = first_detection(self.landed(spark, "detections", days), ["batch_id", self.hotspot_id], self.key).drop("batch_id")
        weather = newest_weather(self.landed(spark, "weather", days), self.station_id)
        rows = daily.unified(hot, weather, self.region, self.refreshed_at, hotspot_id=self.hotspot_id, station_id=self.station_id)
        model = load_or_none(spark, self.model_path) if self.model_path else None
        return daily.scored(daily.processed(rows, self.observed_ndvi), model)
