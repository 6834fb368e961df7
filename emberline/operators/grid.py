"""Grid dimensions. A zone is a function of its index, so no join is needed to
describe one: row, column and centre are arithmetic on ``zone_idx``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.spec import RegionSpec



def zone_centre(row, col, spec: RegionSpec, step: float | None = None) -> tuple[Column, Column]:
    step = step or spec.cell_deg
    return (
        F.lit(spec.min_lat) + row * F.lit(step) + F.lit(step / 2),
        F.lit(spec.min_lon) + col * F.lit(step) + F.lit(step / 2),
    )


def with_zone_columns(df: DataFrame, spec: RegionSpec, centre: bool = True) -> DataFrame:
    """Adds zone_id, row, col and, if wanted, the cell centre to ``zone_idx``."""
    df = df.withColumns(
        {
            "zone_id": F.concat(F.lit("G-"), F.col("zone_idx").cast("string")),
            "row": F.floor(F.col("zone_idx") / spec.n_cols).cast("int"),
            "col": F.pmod("zone_idx", F.lit(spec.n_cols)).cast("int"),
        }
    )
    if not centre:
        return df
    lat, lon = zone_centre(F.col("row"), F.col("col"), spec)
    return df.withColumns({"latitude": lat, "longitude": lon})


def zone_grid(spark: SparkSession, spec: RegionSpec) -> DataFrame:
    """Every fire cell: zone_idx, zone_id, row, col, latitude, longitude."""
    ids = spark.range(spec.n_zones).select(F.col("id").cast("int").alias("zone_idx"))
    return with_zone_columns(ids, spec)


def weather_grid(spark: SparkSession, spec: RegionSpec) -> DataFrame:
    """Centres of the coarse weather cells."""
    rows, cols = spec.shape(spec.weather_cell_deg)
    cells = spark.range(rows * cols).select(
        F.floor(F.col("id") / cols).cast("int").alias("row"),
        F.pmod("id", F.lit(cols)).cast("int").alias("col"),
    )
    lat, lon = zone_centre(F.col("row"), F.col("col"), spec, spec.weather_cell_deg)
    return cells.select("row", "col", lat.alias("latitude"), lon.alias("longitude"))


def lattice_position(i, j, spec: RegionSpec, n_per_side: int) -> tuple[Column, Column]:
    last = max(n_per_side - 1, 1)
    return (
        F.lit(spec.min_lat) + i * F.lit((spec.max_lat - spec.min_lat) / last),
        F.lit(spec.min_lon) + j * F.lit((spec.max_lon - spec.min_lon) / last),
    )


def query_lattice(spark: SparkSession, spec: RegionSpec, n_per_side: int = 4) -> DataFrame:
    """n x n points over the region, both ends included."""
    points = spark.range(n_per_side * n_per_side).select(
        F.col("id").cast("int").alias("point_idx"),
        F.floor(F.col("id") / n_per_side).cast("int").alias("i"),
        F.pmod("id", F.lit(n_per_side)).cast("int").alias("j"),
    )
    lat, lon = lattice_position(F.col("i"), F.col("j"), spec, n_per_side)
    return points.select("point_idx", lat.alias("latitude"), lon.alias("longitude"))


def cell_of(lat, lon, spec: RegionSpec, step: float | None = None) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point; outside points fall off the grid."""
    step = step or spec.cell_deg
    return (
        F.floor((lat - spec.min_lat) / step).cast("int"),
        F.floor((lon - spec.min_lon) / step).cast("int"),
    )


def locate(points: DataFrame, spec: RegionSpec, step: float | None = None) -> DataFrame:
    """Adds the grid row and column of each point and keeps points on the grid."""
    rows, cols = spec.shape(step)
    row, col = cell_of(F.col("latitude"), F.col("longitude"), spec, step)
    return points.withColumns({"row": row, "col": col}).where(
        F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    )


def spine(keys: DataFrame, spec: RegionSpec, spread: bool = False) -> DataFrame:
    """Every zone for every row of ``keys`` (usually the distinct dates).

    The zones are unfolded from their row and column counts, so there is no
    join; arrays hold at most one grid row or one grid column of numbers. With
    ``spread`` the grid rows of a key are dealt to all tasks, which pays off for
    few keys and a fine grid.
    """
    rows = keys.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(spec.n_rows - 1))))
    if spread:
        rows = rows.repartition(*keys.columns, "row")
    cells = rows.withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(spec.n_cols - 1))))
    return cells.select(*keys.columns, (F.col("row") * spec.n_cols + F.col("_col")).alias("zone_idx"))


def grid_shape(zones: DataFrame) -> DataFrame:
    """Rows and columns that a zone table covers."""
    return zones.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
