"""Removing repeated detections and stitching fetches together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

# What identifies a detection.
DETECTION_KEYS = ["latitude", "longitude", "acq_date", "acq_time"]


def first_detection(df: DataFrame, order: Sequence[str], keys: Sequence[str] = DETECTION_KEYS) -> DataFrame:
    """One row per detection: the first by ``order``.

    An aggregation rather than a ranking window, so copies collapse before the
    exchange even if one detection was delivered a million times. ``order``
    should be unique within a detection.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def stitch(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of several fetches by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
