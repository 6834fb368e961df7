"""Classifier metrics, class weights and scaling as plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = ["accuracy", "precision", "recall", "f1_score", "auc_roc", "false_negative_rate"]


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label="label", prediction="prediction", by: Sequence[str] = ()) -> DataFrame:
    """Counts tn, fp, fn, tp over the fixed labels 0 and 1, in one pass."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of a confusion table; a zero denominator gives zero."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
            "false_negative_rate": _ratio(fn, fn + tp),
        }
    )


# Score ranges of a group's rank sum: a power of two.
RANGES = 512


def score_ranges(per_score: DataFrame, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """``per_score`` (by..., _s, ...), one row a score, with ``_range``: the
    ranges follow the quantiles of the group's scores, so each has about the
    same number of them, wherever they lie."""
    by = list(by)
    cuts = F.percentile_approx("_s", [i / ranges for i in range(1, ranges)], 16 * ranges).alias("_cuts")
    if by:
        rows = per_score.join(per_score.groupBy(*by).agg(cuts), by)
    else:
        rows = per_score.withColumn("_cuts", per_score.agg(cuts).scalar())
    # How many cuts are at or below the score, by bisection.
    rows, step = rows.withColumn("_range", F.lit(0)), ranges // 2
    while step:
        up = F.col("_s") >= F.element_at("_cuts", F.col("_range") + step)
        rows, step = rows.withColumn("_range", F.col("_range") + F.when(up, step).otherwise(0)), step // 2
    return rows.drop("_cuts")


def roc_auc(df: DataFrame, label="label", score="score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the tie-aware rank sum; null with one class.

    Equal scores collapse first, map-side. The negatives below a score are
    those of the ranges below (``score_ranges``), of which a group has a fixed
    number, and those below it in its own range. So no task sorts more than its
    ranges, even if all scores are crowded in one spot. Scores may be any numbers.
    """
    by = list(by)
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.count_if(F.col(label) == 0).alias("_neg"), F.count_if(F.col(label) == 1).alias("_pos"))
    )
    ranged = score_ranges(per_score, by)

    def below(rows: DataFrame, part: list[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum("_neg").over(w), F.lit(0)))

    totals = ranged.groupBy(*by, "_range").agg(F.sum("_neg").alias("_neg")).withColumn("_g", F.lit(0))
    before = below(totals, ["_g", *by], "_range", "_before").drop("_neg", "_g")
    rows = below(ranged, [*by, "_range"], "_s", "_within").join(before, [*by, "_range"])
    wins = F.col("_pos") * (F.col("_before") + F.col("_within") + F.col("_neg") * 0.5)
    return rows.groupBy(*by).agg(
        F.try_divide(
            F.sum(wins), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
        ).alias("auc_roc")
    )


def evaluate(df: DataFrame, label="label", prediction="prediction", score="score", by: Sequence[str] = ()) -> DataFrame:
    """All six metrics per group, as one row each.

    The rows are read several times: pass a stored table if they are costly.
    """
    by = list(by)
    table = rates(confusion(df, label, prediction, by))
    auc = roc_auc(df, label, score, by)
    if by:
        joined = table.join(auc, by, "left")
    else:
        joined = table.withColumn("auc_roc", auc.scalar())
    return joined.select(*by, *METRICS)


def comparison(metric_rows: DataFrame, digits: int = 4) -> DataFrame:
    """Model by metric table, rounded."""
    return metric_rows.select("model", *[F.round(m, digits).alias(m) for m in METRICS])


def unpivoted(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(model, metric, value) rows of a comparison table."""
    return table.unpivot(["model"], list(metrics), "metric", "value")


def best_per_metric(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Highest value per metric and the first model, by name, that has it."""
    best = F.min(F.struct((-F.col("value")).alias("v"), F.col("model").alias("m")))
    return (
        unpivoted(table, metrics)
        .where("value is not null")
        .groupBy("metric")
        .agg(best.alias("_b"))
        .select("metric", F.col("_b.m").alias("best_model"), (-F.col("_b.v")).alias("best_value"))
    )


def class_weights(df: DataFrame, label="label") -> DataFrame:
    """One row: class counts, balanced weights and the positive-class weight."""
    n0, n1 = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    n = (n0 + n1).cast("double")
    return df.agg(
        n0.alias("n_negative"),
        n1.alias("n_positive"),
        F.try_divide(n, 2 * n0).alias("weight_negative"),
        F.try_divide(n, 2 * n1).alias("weight_positive"),
        (n0 / F.greatest(n1, F.lit(1))).alias("scale_pos_weight"),
    )


def with_class_weight(df: DataFrame, label="label", out="weight", scheme="balanced") -> DataFrame:
    """A weight per row from the class counts, which are a scalar subquery."""
    positive, negative = {
        "balanced": ("weight_positive", "weight_negative"),
        "scale_pos": ("scale_pos_weight", None),
    }[scheme]
    counts = class_weights(df, label)
    weights = counts.select(
        F.struct(
            F.col(positive).alias("p"), (F.col(negative) if negative else F.lit(1.0)).alias("n")
        ).alias("w")
    )
    weighted = df.withColumn("_w", weights.scalar())
    value = F.when(F.col(label) == 1, F.col("_w.p")).otherwise(F.col("_w.n"))
    return weighted.withColumn(out, value).drop("_w")


def label_rate(df: DataFrame, label="fire_risk_label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(label).alias("n_positive"),
        F.avg(label).alias("positive_rate"),
    )


def split_statistics(df: DataFrame, split="split", label="fire_risk_label") -> DataFrame:
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg(label).alias("positive_rate"),
    )


def column_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population standard deviation, in one scan."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"))
            for c in columns
        ]
    )
    return stats.select(F.explode(rows).alias("s")).select("s.*")


def standardise(df: DataFrame, scale: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the given statistics; a constant column becomes zero.

    ``scale`` has one row per feature and enters as a scalar subquery.
    """
    def moment(name: str, kind: str):
        return F.max(F.when(F.col("feature") == name, F.col(kind))).alias(f"{kind}_{name}")

    one = scale.agg(*[moment(c, "mean") for c in columns], *[moment(c, "std") for c in columns])
    df_scaled = df.withColumn("_scale", one.select(F.struct(*one.columns)).scalar())

    def scaled(c: str) -> Column:
        std = F.col(f"_scale.std_{c}")
        return (F.col(c) - F.col(f"_scale.mean_{c}")) / F.when(std > 0, std).otherwise(F.lit(1.0))

    return df_scaled.withColumns({c: scaled(c) for c in columns}).drop("_scale")
