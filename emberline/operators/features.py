"""Cleaning and feature columns of zone-days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from emberline.functions.vegetation import ndvi, ndvi_proxy
from emberline.operators.nearest import grown, one_row_per_day
from emberline.schemas import LIVE_FEATURES

WEATHER = ["wx_temperature_c", "wx_humidity_pct", "wx_wind_speed_ms", "wx_precipitation_mm"]


#: Parts of a group's rows in which the middle is searched, as an accuracy of
#: the sketch; the state of a group is bounded by it.
ACCURACY = 4096


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("date",), accuracy: int = ACCURACY) -> DataFrame:
    """Exact median of each column per group, as ``_med_<column>``.

    Selection in two passes, neither of which holds a group's values. The first
    takes a sketch whose ranks are wrong by one in ``accuracy`` rows at most,
    and from it two values that surely enclose the middle. The second counts
    the rows below and collapses those between them to distinct values, a
    thousandth of the group; only these are ranked. Both shrink on the map side.
    """
    by = list(by)
    entries = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])
    values = df.select(*by, F.inline(entries)).where("_x is not null")
    margin = 2 / accuracy
    bounds = values.groupBy(*by, "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", [0.5 - margin, 0.5 + margin], accuracy).alias("_q")
    )
    placed = values.join(one_row_per_day(bounds, by, "_c"), [*by, "_c"]).where(F.col("_x") <= F.col("_q")[1])
    near = F.when(F.col("_x") >= F.col("_q")[0], F.col("_x"))
    counted = placed.groupBy(*by, "_c", near.alias("_x")).agg(F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*by, "_c").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("_rows").over(upto))
    # Ranks from 0: a value takes those from _upto - _rows to _upto - 1.
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")

    def at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_rows") <= rank) & (rank < F.col("_upto")), F.col("_x")))

    middle = ranked.groupBy(*by, "_c").agg((at(low) * 0.5 + at(high) * 0.5).alias("_m"))
    sure = F.coalesce("_m", F.raise_error(F.lit("the sketch does not enclose the median")).cast("double"))
    of = [F.max(F.when(F.col("_c") == i, sure)).alias(f"_med_{c}") for i, c in enumerate(columns)]
    return middle.groupBy(*by).agg(*of)


def impute_median(df: DataFrame, columns: Sequence[str] = WEATHER, by: Sequence[str] = ("date",)) -> DataFrame:
    """Missing values become the median over the group's zones."""
    filled = df.join(one_row_per_day(medians(df, columns, by), by), list(by), "left")
    return filled.withColumns({c: F.coalesce(c, f"_med_{c}") for c in columns}).drop(
        *[f"_med_{c}" for c in columns]
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    """No detection nearby: zero radiative power and a false flag."""
    return df.withColumns(
        {
            "fire_frp": F.coalesce("fire_frp", F.lit(0.0)),
            "active_fire_nearby": F.coalesce("active_fire_nearby", F.lit(False)),
        }
    )


def with_ndvi(df: DataFrame, observed: DataFrame | None, active) -> DataFrame:
    """Observed greenness by zone and date where there is one, else the proxy.

    ``observed`` has one row per (date, zone_idx), the keys the zone-days are
    already partitioned by, so this join moves only the observations.
    """
    proxy = ndvi_proxy("zone_idx", "date", active, "wx_precipitation_mm")
    if observed is None:
        return df.withColumn("ndvi", ndvi(F.lit(None).cast("double"), proxy))
    seen = observed.select("date", "zone_idx", F.col("ndvi").alias("_seen"))
    return df.join(grown(seen), ["date", "zone_idx"], "left").withColumn("ndvi", ndvi("_seen", proxy)).drop("_seen")


def rule_label(active, fwi, cutoff: float = 60.0):
    """Label without ground truth: a nearby detection or an extreme index."""
    return F.coalesce(active | (fwi > cutoff), F.lit(False)).cast("int")


def feature_matrix(df: DataFrame, columns: Sequence[str] = LIVE_FEATURES, label: str = "fire_risk_label") -> DataFrame:
    """Feature columns, flags as integers, with keys and label beside them."""
    keys = [c for c in ("date", "zone_idx", "zone_id") if c in df.columns]
    flags = {name for name, kind in df.dtypes if kind == "boolean"}
    return df.select(
        *keys,
        *[F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in columns],
        *([label] if label in df.columns else []),
    )
