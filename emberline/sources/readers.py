"""File sources with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from emberline import schemas
from emberline.functions.scalar import acquisition_time, in_box, in_season, is_error_payload
from emberline.spec import RegionSpec, SeasonSpec

CORRUPT = "_corrupt"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def folders_like(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, listed at once."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return sorted(p.toString() for p in spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)) if found else []


def input_files(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of the files in a folder and in the folders in it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for pattern in ("*", "*/*") for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(hadoop_path, pattern)) or ()]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found if f.isFile()))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of CSV files by header; unreadable values are null and the raw line
    is kept in ``_corrupt``. A path without files gives an empty frame."""
    full = schema.add(CORRUPT, T.StringType()) if CORRUPT not in schema.names else schema
    if not path_exists(spark, path):
        return empty(spark, full)
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", True)
        .csv(path)
    )


def _fields(schema: T.StructType) -> T.StructType:
    """A copy: adding to a StructType changes it in place."""
    return T.StructType(list(schema.fields))


def payload_status(spark: SparkSession, path: str) -> DataFrame:
    """Per landed file: is it an error message instead of data?

    Judged by the first line: an error answer has its message there, a data
    file its header. Lines are numbered in reading order within a task and the
    first block of a file is read by one, so the smallest number is the first
    line; a file of any size goes through one line at a time.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.substring("value", 1, 200).alias("value"),
        F.monotonically_increasing_id().alias("n"),
    )
    first = lines.where("start = 0").groupBy("file_path").agg(F.min_by("value", "n").alias("value"))
    return first.select("file_path", is_error_payload("value").alias("rejected"))


def read_hotspots(
    spark: SparkSession,
    path: str,
    region: RegionSpec | None = None,
    schema: T.StructType = schemas.HOTSPOT,
    fetched_at=None,
) -> DataFrame:
    """Landed detection files as typed rows with fetch and acquisition time.

    Files that carry an error message contribute nothing (``quarantined`` names
    them), nor do rows without a place (``quarantined_rows`` has them).
    """
    rows = _accepted(spark, path, schema).where(f"not {_BAD_ROW}").drop(CORRUPT, "file_path")
    if region is not None:
        rows = rows.where(in_box("latitude", "longitude", region))
    return rows.withColumns(
        {
            "fetched_at": F.current_timestamp() if fetched_at is None else fetched_at,
            "acq_datetime": acquisition_time("acq_date", "acq_time"),
        }
    )


# A line that did not fit the schema and left no place.
_BAD_ROW = f"({CORRUPT} is not null and latitude is null)"


def _accepted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of files that carry data, with ``file_path``. The rejected
    names are few; the planner chooses the anti-join by their measured size."""
    raw = read_csv(spark, path, _fields(schema))
    if not path_exists(spark, path):
        return raw.withColumn("file_path", F.lit(""))
    bad = payload_status(spark, path).where("rejected").select("file_path")
    return raw.withColumn("file_path", F.col("_metadata.file_path")).join(bad, "file_path", "left_anti")


def quarantined_rows(spark: SparkSession, path: str, schema: T.StructType = schemas.HOTSPOT) -> DataFrame:
    """(file_path, line) of the rows that ``read_hotspots`` refuses."""
    return _accepted(spark, path, schema).where(_BAD_ROW).select("file_path", F.col(CORRUPT).alias("line"))


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Names of landed files that were refused."""
    return payload_status(spark, path).where("rejected")


def season_scan(hist: DataFrame, seasons: SeasonSpec, region: RegionSpec | None = None) -> DataFrame:
    """Detections of the wanted fire seasons, labelled with their year.

    The year list prunes partitions where the table is laid out by
    ``fire_season_year``; the date ranges and the box reach the file scan.
    """
    year = "fire_season_year"
    df = hist
    if year in df.columns:
        df = df.where(F.col(year).isin(*seasons.years))
    df = df.where(in_season("acq_date", seasons))
    if region is not None:
        df = df.where(in_box("latitude", "longitude", region))
    return df if year in df.columns else df.withColumn(year, F.year("acq_date"))


REQUIRED_WEATHER = ["temperature_c", "humidity_pct", "pressure_hpa"]


def flatten_weather(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """One typed row per weather answer; answers without the required members go.

    Optional members default to zero, a missing condition to ``Unknown``.
    """
    j = payloads.withColumn("_j", F.from_json(payload, schemas.WEATHER_PAYLOAD))
    zero = F.lit(0.0)
    flat = j.select(
        *keep,
        "latitude",
        "longitude",
        F.col("_j.main.temp").alias("temperature_c"),
        F.col("_j.main.humidity").alias("humidity_pct"),
        F.col("_j.main.pressure").alias("pressure_hpa"),
        F.coalesce("_j.wind.speed", zero).alias("wind_speed_ms"),
        F.coalesce("_j.wind.deg", zero).alias("wind_deg"),
        F.coalesce(F.col("_j.rain.`1h`"), zero).alias("precipitation_mm"),
        F.coalesce("_j.clouds.all", zero).alias("clouds_pct"),
        F.coalesce(F.try_element_at("_j.weather", F.lit(1))["main"], F.lit("Unknown")).alias("weather_main"),
    )
    return flat.dropna(subset=REQUIRED_WEATHER)


def read_weather_json(spark: SparkSession, path: str, fetched_at=None) -> DataFrame:
    """Landed weather answers, one per line as latitude, longitude, payload and,
    if known, fetched_at; else they are stamped now."""
    stamp = F.current_timestamp() if fetched_at is None else fetched_at
    if not path_exists(spark, path):
        return empty(spark, schemas.WEATHER_POINT).withColumn("fetched_at", stamp)
    landed = spark.read.schema(schemas.WEATHER_LANDED).json(path)
    return flatten_weather(landed.withColumn("fetched_at", F.coalesce("fetched_at", stamp)), keep=["fetched_at"])


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A stage written earlier; a missing one is a clear error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} not found: run the stage that writes it first")
    reader = spark.read.schema(_fields(schema))
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_weather_daily(spark: SparkSession, path: str, start: str, end: str, fmt: str = "parquet") -> DataFrame:
    """Daily weather rows of a date range."""
    days = read_table(spark, path, schemas.WEATHER_DAILY, fmt)
    return days.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
