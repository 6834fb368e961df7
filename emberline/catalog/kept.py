"""Results that several queries of an application share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from emberline.sources.readers import input_files

_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, what, make: Callable[[], object]):
    """``make()``, called again only for another application, another table
    folder or changed files in it."""
    key = (spark.sparkContext.applicationId, input_files(spark, sf), what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
