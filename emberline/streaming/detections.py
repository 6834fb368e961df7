"""Structured Streaming jobs over landed detections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from emberline.operators.nearest import zones_within
from emberline.spec import RegionSpec

# Lateness allowed (a poll re-reads the last day) and refresh interval.
LATENESS = "1 day"
INTERVAL = "15 minutes"


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


HEADER, ROW, REFUSED = "header", "row", "refused"


def line_stream(spark: SparkSession, path: str, max_files: int | None = None, name_filter: str | None = None) -> DataFrame:
    """The lines of landed text files as a stream of file_path and ``line``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def classified(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Each line with its ``kind`` and, of rows, the columns of ``schema``.

    A data file begins with its header. Of all other lines those that give a
    place are rows and the others are refused. Error answers have no header, so
    ``accepted`` and ``refused_files`` tell them by that. Blank lines go. Each
    line is judged by itself, so a stream needs no state and a file is read once.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = lines.where("trim(line) <> ''").withColumn("_row", F.from_csv("line", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.fields), options))
    names = F.lit(",".join(schema.names))
    placed = F.col("_row.latitude").isNotNull() & F.col("_row.longitude").isNotNull()
    kind = F.when(F.trim("line") == names, HEADER).when(placed, ROW).otherwise(REFUSED)
    rows = read.withColumn("kind", kind)
    is_row = F.col("kind") == ROW
    return rows.select(
        "file_path",
        F.when(F.col("kind") == REFUSED, F.col("line")).alias("line"),
        *[F.when(is_row, F.col(f"_row.{c}")).alias(c) for c in schema.names],
        "kind",
    )


def landed_schema(schema: T.StructType) -> T.StructType:
    """That of the table ``run_quarantine`` writes."""
    text = [T.StructField("file_path", T.StringType()), T.StructField("line", T.StringType())]
    return T.StructType([*text, *schema.fields, T.StructField("kind", T.StringType())])


def run_quarantine(spark: SparkSession, path: str, out: str, checkpoint: str, schema: T.StructType, max_files: int | None = None) -> None:
    """Reads the new files of a folder once and writes header lines, rows and
    refused lines to a folder each, then stops."""
    lines = classified(line_stream(spark, path, max_files), schema)
    writer = lines.writeStream.outputMode("append").trigger(availableNow=True).partitionBy("kind").format("parquet")
    _finish(writer.option("path", out).option("checkpointLocation", checkpoint).start(), None)


def _data_files(landed: DataFrame) -> DataFrame:
    return landed.where(F.col("kind") == HEADER).select("file_path").distinct()


def accepted(landed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The rows of data files in what ``run_quarantine`` wrote. ``landed`` may
    be a stream; ``files`` is then the same table, not streamed."""
    rows = landed.where(F.col("kind") == ROW).drop("kind", "line")
    return rows.join(_data_files(landed if files is None else files), "file_path", "left_semi")


def refused_rows(landed: DataFrame) -> DataFrame:
    """(file_path, line) of the lines of data files that are no rows."""
    return landed.where(F.col("kind") == REFUSED).select("file_path", "line").join(_data_files(landed), "file_path", "left_semi")


def refused_files(landed: DataFrame) -> DataFrame:
    """Names of the files without a header: error answers."""
    return landed.where(F.col("kind") != HEADER).select("file_path").distinct().join(_data_files(landed), "file_path", "left_anti")


def deduplicated(
    stream: DataFrame, keys: Sequence[str], event_time: str = "acq_datetime", lateness: str = LATENESS
) -> DataFrame:
    """Each detection once, although consecutive polls repeat it.

    State holds the keys of one lateness span, not of the whole history.
    """
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def zone_windows(
    stream: DataFrame,
    region: RegionSpec,
    event_time: str = "acq_datetime",
    interval: str = INTERVAL,
) -> DataFrame:
    """Detections, total and peak radiative power per zone and refresh interval.

    The zones of a detection are computed from its coordinates, so no table is
    joined and the only exchange is the partially aggregated one.
    """
    near = zones_within(stream, region)
    return (
        near.groupBy(F.window(event_time, interval).alias("w"), "zone_idx")
        .agg(F.count(F.lit(1)).alias("n_detections"), F.sum("frp").alias("frp_sum"), F.max("frp").alias("frp_max"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "zone_idx",
            "n_detections",
            "frp_sum",
            "frp_max",
        )
    )


def run_available(
    stream: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None, mode: str = "append"
) -> None:
    """Processes what is there into Parquet and stops. Without ``timeout_s``
    it takes as long as it takes."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    query = writer.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    _finish(query, timeout_s)


def _finish(query, timeout_s: int | None) -> None:
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout_s} s")


def refresh_batches(
    stream: DataFrame,
    refresh: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
):
    """Runs ``refresh`` on each micro-batch and its number. A batch may be
    replayed after a failure, so ``refresh`` has to replace what it wrote
    (see ``plans.refresh``)."""
    return (
        stream.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": INTERVAL}))
        .start()
    )


def run_refresh(stream: DataFrame, refresh, checkpoint: str, timeout_s: int | None = None) -> None:
    """``refresh_batches`` over what is there, then stop."""
    _finish(refresh_batches(stream, refresh, checkpoint, {"availableNow": True}), timeout_s)
