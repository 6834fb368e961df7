"""Risk scores to ranked, explained alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.scalar import _col, clip, one_decimal
from emberline.spec import AlertSpec


def fallback_risk(fwi) -> Column:
    """Risk without a model: the danger index over its nominal maximum."""
    return clip(_col(fwi) / 100.0, 0, 1)


def severity(score, spec: AlertSpec) -> Column:
    s = _col(score)
    return (
        F.when(s >= spec.extreme, "EXTREME")
        .when(s >= spec.high, "HIGH")
        .when(s >= spec.moderate, "MODERATE")
        .when(s.isNotNull(), "LOW")
    )


def reason(spec: AlertSpec) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(F.col("active_fire_nearby"), F.lit("active satellite hotspot nearby")),
        F.when(
            F.col("fwi") > spec.extreme_fwi,
            F.concat(F.lit("extreme FWI ("), one_decimal("fwi"), F.lit(")")),
        ),
        F.when(
            F.col("wx_wind_speed_ms") > spec.high_wind_ms,
            F.concat(F.lit("high wind ("), one_decimal("wx_wind_speed_ms"), F.lit(" m/s)")),
        ),
    )
    return F.when(parts == "", F.lit("elevated model risk score")).otherwise(parts)


def alerts(scored: DataFrame, spec: AlertSpec = AlertSpec(), triggered_at: Column | None = None) -> DataFrame:
    """Zones at or above the threshold with severity, reason and time.

    Unordered: a consumer picks ``ranked`` or ``top_alerts``. A null or NaN
    score never alerts.
    """
    score = F.nanvl(F.col("risk_score"), F.lit(None).cast("double"))
    keys = [c for c in ("date", "zone_idx") if c in scored.columns]
    return (
        scored.where(score >= spec.threshold)
        .select(
            *keys,
            "zone_id",
            "latitude",
            "longitude",
            "risk_score",
            severity("risk_score", spec).alias("severity"),
            reason(spec).alias("reason"),
            (F.current_timestamp() if triggered_at is None else triggered_at).alias("triggered_at"),
        )
    )


def ranked(alert_rows: DataFrame, tie: str = "zone_idx") -> DataFrame:
    """Highest risk first, ties by zone: a range-partitioned sort."""
    return alert_rows.orderBy(F.desc("risk_score"), *[c for c in ("date", tie) if c in alert_rows.columns])


def top_alerts(alert_rows: DataFrame, k: int, tie: str = "zone_idx") -> DataFrame:
    """The k highest alerts; each task keeps k rows, nothing is sorted whole."""
    return ranked(alert_rows, tie).limit(k)


def remainder(alert_rows: DataFrame, k: int) -> DataFrame:
    """How many alerts a list of k leaves out."""
    n = F.count(F.lit(1))
    return alert_rows.agg(
        n.alias("total_alerts"), F.greatest(n - F.lit(k), F.lit(0)).alias("more_alerts")
    )


def alerting_zones(alert_rows: DataFrame, severities=("HIGH", "EXTREME")) -> DataFrame:
    """Distinct zones (per date) with an alert of the given severities."""
    keys = [c for c in ("date", "zone_idx", "zone_id") if c in alert_rows.columns]
    return alert_rows.where(F.col("severity").isin(*severities)).select(*keys).distinct()
