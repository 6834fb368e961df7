"""Next-step spread exposure seeded from alerts or from active fires."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from emberline.operators import adjacency as N
from emberline.operators.alerts import severity
from emberline.spec import AlertSpec, RegionSpec, SpreadSpec


def alert_seeds(
    scored: DataFrame, alert_spec: AlertSpec = AlertSpec(), spread_spec: SpreadSpec = SpreadSpec()
) -> DataFrame:
    """Cells with HIGH or EXTREME alerts burning.

    The alert is a function of the same row's score, so membership is a column
    and needs no join back to the alert list.
    """
    hot = (F.col("risk_score") >= alert_spec.threshold) & severity("risk_score", alert_spec).isin(
        "HIGH", "EXTREME"
    )
    return N.spread_inputs(scored, hot, spread_spec)


def fire_seeds(processed: DataFrame, spread_spec: SpreadSpec = SpreadSpec()) -> DataFrame:
    """Cells with an active fire nearby burning."""
    return N.spread_inputs(processed, F.col("active_fire_nearby"), spread_spec)


def member_seeds(processed: DataFrame, zones: DataFrame, spread_spec: SpreadSpec = SpreadSpec()) -> DataFrame:
    """Cells named in a stored list of (date, zone_idx) burning."""
    listed = zones.select("date", "zone_idx").distinct().withColumn("_hot", F.lit(True))
    joined = processed.join(listed, ["date", "zone_idx"], "left")
    return N.spread_inputs(joined, F.col("_hot"), spread_spec).drop("_hot")


def exposure(
    cells: DataFrame, region: RegionSpec, spec: SpreadSpec = SpreadSpec(), by: Sequence[str] = ("date",),
    wind_deg: str = "mean_wind_deg",
) -> DataFrame:
    """Ignition probability of every exposed cell under the region's mean wind."""
    return N.ignition_probability(cells, N.mean_wind(cells, by), region, spec, by, wind_deg)


def projection(
    cells: DataFrame, region: RegionSpec, spec: SpreadSpec = SpreadSpec(), by: Sequence[str] = ("date",)
) -> DataFrame:
    """Per group: expected new fires, cells burning out, counts after the step.

    ``cells`` is read three times (counts, wind, neighbours): pass a stored snapshot.
    """
    return N.next_step(cells, exposure(cells, region, spec, by), spec, by)
