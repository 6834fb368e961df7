"""Neighbour join and one-step spread exposure on the zone grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from emberline.functions import spread as S
from emberline.operators.nearest import one_row_per_day
from emberline.spec import RegionSpec, SpreadSpec


def _offsets(spec: SpreadSpec):
    return F.array(
        *[
            F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(b).alias("bearing"))
            for dr, dc, b in S.neighbours(spec.row_axis)
        ]
    )


def neighbour_edges(
    burning: DataFrame, region: RegionSpec, spec: SpreadSpec = SpreadSpec(), by: Sequence[str] = ("date",)
) -> DataFrame:
    """(group, from zone, to zone, bearing) for the up to eight neighbours of
    each given cell that lie on the grid."""
    e = burning.select(*by, "row", "col", F.explode(_offsets(spec)).alias("_o"))
    e = e.withColumns({"to_row": F.col("row") + F.col("_o.dr"), "to_col": F.col("col") + F.col("_o.dc")})
    e = e.where(
        F.col("to_row").between(0, region.n_rows - 1) & F.col("to_col").between(0, region.n_cols - 1)
    )
    return e.select(
        *by,
        (F.col("row") * region.n_cols + F.col("col")).alias("from_zone"),
        (F.col("to_row") * region.n_cols + F.col("to_col")).alias("to_zone"),
        F.col("_o.bearing").alias("bearing"),
    )


def mean_wind(zones: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Mean wind speed and bearing; the plain mean of bearings and the circular one."""
    rad = F.radians("wx_wind_deg")
    return zones.groupBy(*by).agg(
        F.avg("wx_wind_speed_ms").alias("mean_wind_ms"),
        F.avg("wx_wind_deg").alias("mean_wind_deg"),
        F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0)).alias(
            "circular_wind_deg"
        ),
    )


def spread_inputs(zones: DataFrame, ignition, spec: SpreadSpec = SpreadSpec()) -> DataFrame:
    """Dryness, fuel, bare-ground flag and initial cell state of each zone."""
    df = zones.withColumns(
        {
            "dryness": S.dryness("ffmc"),
            "fuel": S.fuel("ndvi"),
            "non_fuel": F.coalesce(S.is_bare("ndvi", spec), F.lit(False)),
            "ignition": F.coalesce(ignition, F.lit(False)),
        }
    )
    return df.withColumn("state", S.initial_state("ignition", "non_fuel"))


def ignition_probability(
    cells: DataFrame,
    wind: DataFrame,
    region: RegionSpec,
    spec: SpreadSpec = SpreadSpec(),
    by: Sequence[str] = ("date",),
    wind_deg: str = "mean_wind_deg",
) -> DataFrame:
    """Chance that each unburned cell next to a burning one ignites in a step.

    ``cells`` has one row per group and zone with state, dryness and fuel;
    ``wind`` one row per group. A burning cell sends its eight bearings to its
    neighbours, every cell sends itself, and one aggregation by zone brings
    them together: a single exchange instead of a self-join. A cell collects
    at most eight bearings.
    """
    keys = [*by, "row", "col"]
    here = F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(None).cast("int").alias("bearing"))
    sent = F.when(F.col("state") == S.BURNING, F.concat(F.array(here), _offsets(spec))).otherwise(
        F.array(here)
    )
    told = cells.select(*keys, "state", "dryness", "fuel", F.explode(sent).alias("_o"))
    own = F.col("_o.bearing").isNull()
    told = told.select(
        *by,
        (F.col("row") + F.col("_o.dr")).alias("row"),
        (F.col("col") + F.col("_o.dc")).alias("col"),
        F.when(own, F.col("state")).alias("state"),
        F.when(own, F.col("dryness")).alias("dryness"),
        F.when(own, F.col("fuel")).alias("fuel"),
        F.col("_o.bearing").alias("bearing"),
    )
    met = told.groupBy(*keys).agg(
        F.max("state").alias("state"),
        F.max("dryness").alias("dryness"),
        F.max("fuel").alias("fuel"),
        F.sort_array(F.collect_list("bearing")).alias("bearings"),
    )
    # Off-grid and burnt-out targets drop here; so do cells without a burning neighbour.
    met = met.where((F.col("state") == S.UNBURNED) & (F.size("bearings") > 0))
    met = met.join(one_row_per_day(wind, by), list(by))

    def log_survival(bearing):
        aligned = S.wind_alignment(bearing, wind_deg, spec)
        p = S.spread_probability("dryness", "fuel", "mean_wind_ms", aligned, spec)
        return F.log(1.0 - p)

    total = F.aggregate("bearings", F.lit(0.0), lambda acc, b: acc + log_survival(b))
    return met.select(
        *by,
        (F.col("row") * region.n_cols + F.col("col")).alias("zone_idx"),
        F.size("bearings").alias("burning_neighbours"),
        (1.0 - F.exp(total)).alias("p_ignite"),
    )


def state_counts(cells: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Cells by state, and burnt cells as a share of those that can burn."""
    s = F.col("state")
    burnable = F.count_if(s != S.NON_FUEL)
    return cells.groupBy(*by).agg(
        F.count_if(s == S.UNBURNED).alias("n_unburned"),
        F.count_if(s == S.BURNING).alias("n_burning"),
        F.count_if(s == S.BURNED).alias("n_burned"),
        F.count_if(s == S.NON_FUEL).alias("n_non_fuel"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(s == S.BURNED), burnable), F.lit(0.0)).alias(
            "burned_pct"
        ),
    )


def next_step(
    cells: DataFrame, exposure: DataFrame, spec: SpreadSpec = SpreadSpec(), by: Sequence[str] = ("date",)
) -> DataFrame:
    """Counts after one step: burning cells burn out, exposed ones may ignite."""
    expected = exposure.groupBy(*by).agg(
        F.sum("p_ignite").alias("expected_new_burning"), F.count(F.lit(1)).alias("n_exposed")
    )
    now = state_counts(cells, by)
    return now.join(expected, list(by), "left").select(
        *by,
        F.lit(1).alias("step"),
        F.lit(spec.minutes_per_step).alias("minutes_elapsed"),
        F.coalesce("expected_new_burning", F.lit(0.0)).alias("expected_new_burning"),
        F.coalesce("n_exposed", F.lit(0)).alias("n_exposed"),
        F.col("n_burning").alias("n_burning_out"),
        (F.col("n_burned") + F.col("n_burning")).alias("n_burned_after"),
        "n_non_fuel",
    )
