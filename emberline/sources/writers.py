"""Sinks. Parquet is the default; CSV and JSON exist for exchange."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.session import scratch_dir
from emberline.spec import RegionSpec


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Writes a table; partition values are brought together first, so a value
    makes a few large files and not one per task. AQE splits a hot value."""
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


#: Bits of a row or column number in the order of ``write_clustered``.
ORDER_BITS = 16


def place_order(latitude: str, longitude: str, region: RegionSpec) -> Column:
    """A number whose neighbours are near each other in both directions: the
    bits of the row and the column in turn, of a grid of 2^16 cells a side."""

    def cell(value: str, low: float, high: float) -> Column:
        share = (F.col(value) - low) / (high - low) * (1 << ORDER_BITS)
        return F.least(F.greatest(F.floor(share), F.lit(0)), F.lit((1 << ORDER_BITS) - 1)).cast("long")

    row, col = cell(latitude, region.min_lat, region.max_lat), cell(longitude, region.min_lon, region.max_lon)

    def bits(value: Column, at: int) -> Column:
        taken = [F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1)), 2 * i + at) for i in range(ORDER_BITS)]
        return reduce(lambda a, b: a.bitwiseOR(b), taken)

    return bits(row, 1).bitwiseOR(bits(col, 0))


def write_clustered(
    df: DataFrame, path: str, region: RegionSpec, latitude: str = "latitude", longitude: str = "longitude", files: int | None = None, group_bytes: int | None = None
) -> None:
    """Writes points sorted by ``place_order``, in ranges: each file, and each
    row group in it, covers a small patch, so a box skips most of them by their
    statistics, whichever way it lies. A crowded patch takes several files.
    Points without a place come first."""
    placed = df.withColumn("_order", place_order(latitude, longitude, region))
    keys = ["_order", latitude, longitude]
    ranged = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).drop("_order").write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows behind a table in the shared scratch folder.

    Cuts the lineage where a result is read several times (model fitting,
    metrics), so that later passes and lost executors read files instead of
    running the whole plan again.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_training_set(df: DataFrame, path: str) -> None:
    """Training rows laid out by season year, which the temporal split prunes."""
    write_table(df.withColumn("season_year", F.year("date")), path, ["season_year"])


def training_metadata(train: DataFrame, test: DataFrame, features: Sequence[str], split_method: str) -> DataFrame:
    """One row that describes a training run."""

    def side(df: DataFrame, name: str):
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.array(F.min("date"), F.max("date")).alias(f"{name}_date_range"),
            F.avg("fire_risk_label").alias(f"{name}_positive_rate"),
        )

    other = side(test, "test")
    return (
        side(train, "train")
        .withColumn("_t", other.select(F.struct(*other.columns)).scalar())
        .select(
            "*",
            "_t.*",
            F.array(*[F.lit(f) for f in features]).alias("feature_columns"),
            F.lit(split_method).alias("split_method"),
        )
        .drop("_t")
    )


def write_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)
