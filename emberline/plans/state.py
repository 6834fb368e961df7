"""Stored snapshots: the current state, its summary, windows over its history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.operators.alerts import severity
from emberline.operators.sequences import sequences
from emberline.plans.versions import VersionedDates
from emberline.spec import AlertSpec


def newest(state: VersionedDates, spark: SparkSession, version: int | None = None) -> DataFrame:
    """Every zone's row of the last date in a version of the stored state. The
    rows of a date hold all zones, so no other date is opened."""
    last = state.ledger(spark, version).where("version is not null").agg(F.max("date")).head()[0]
    return state.read(spark, version, [] if last is None else [last])


def current_state(state: DataFrame, key: str = "zone_idx", order: str = "refreshed_at") -> DataFrame:
    """Latest row per zone. The maximum is taken map-side first, so a long
    history leaves each task with one row per zone."""
    rest = [c for c in state.columns if c != key]
    latest = state.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_s"))
    return latest.select(key, "_s.*").select(*state.columns)


def summary(
    scored: DataFrame, spec: AlertSpec = AlertSpec(), by: Sequence[str] = ("date",)
) -> DataFrame:
    """Zones, alerts and risk in one aggregation.

    ``n_high`` and ``n_extreme`` count alerts; ``zones_*`` count all zones by band.
    """
    s = F.col("risk_score")
    hit = s >= spec.threshold
    band = severity("risk_score", spec)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_zones"),
        F.count_if(hit).alias("total_alerts"),
        F.count_if(hit & (band == "EXTREME")).alias("n_extreme"),
        F.count_if(hit & (band == "HIGH")).alias("n_high"),
        F.count_if(hit & (band == "MODERATE")).alias("n_moderate"),
        F.count_if(hit & (band == "LOW")).alias("n_low"),
        F.count_if(band == "MODERATE").alias("zones_moderate"),
        F.count_if(band == "LOW").alias("zones_low"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_risk_score"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_risk_score"),
    )


def summary_of(state: VersionedDates, spark: SparkSession, refreshed_at: str = "ingested_at") -> DataFrame:
    """Status, time and numbers of the newest version; before the first refresh
    one row that says so."""
    numbers = "total_zones LONG, total_alerts LONG, n_extreme LONG, n_high LONG, max_risk_score DOUBLE, mean_risk_score DOUBLE"
    if not state.numbers(spark):
        row = spark.range(1).select(F.lit("not_initialised").alias("status"), F.lit(None).cast("timestamp").alias("timestamp"))
        return row.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in numbers.split(", "))])
    rows = state.read(spark)
    when = rows.agg(F.max(refreshed_at).alias("t")).select("t").scalar()
    names = [c.split()[0] for c in numbers.split(", ")]
    return summary(rows, by=()).select(F.lit("ok").alias("status"), when.alias("timestamp"), *names)


def snapshot_sequences(state: DataFrame, features: Sequence[str], n: int = 7) -> DataFrame:
    """Trailing windows over stored snapshots, for scoring a sequence model live."""
    return sequences(
        state, n_days=n, features=features, label=None, gap_free=False, order="refreshed_at"
    )
