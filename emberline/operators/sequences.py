"""Trailing-day feature sequences per zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from emberline.schemas import TRAINING_FEATURES


def sequences(
    df: DataFrame,
    n_days: int = 7,
    features: Sequence[str] = TRAINING_FEATURES,
    label: str | None = "fire_risk_label",
    gap_free: bool = True,
    within: Sequence[str] = (),
    zone: str = "zone_idx",
    order: str = "date",
) -> DataFrame:
    """Full windows of the last ``n_days`` rows of each zone, with the last label.

    ``gap_free`` also asks that the rows are consecutive days; without it a
    window may bridge a season break. ``within`` (say a split column) keeps
    windows from mixing its values. A zone has one row a day, so a partition of
    the window is as long as the calendar, never a share of the table.
    """
    w = Window.partitionBy(*within, zone).orderBy(order)
    frame = w.rowsBetween(-(n_days - 1), 0)
    out = df.select(
        *within,
        zone,
        order,
        F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(frame).alias("sequence"),
        F.first(order).over(frame).alias("first_day"),
        *([F.col(label).alias("label")] if label else []),
    ).where(F.size("sequence") == n_days)
    if gap_free:
        out = out.where(F.datediff(order, "first_day") == n_days - 1)
    return out


def flattened(seq: DataFrame, vector: bool = False) -> DataFrame:
    """One flat feature array (or ML vector) per window, day by day."""
    flat = F.flatten("sequence")
    return seq.withColumn("features", array_to_vector(flat) if vector else flat).drop("sequence")
