"""Named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.catalog.reference_sql import sql as with_steps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Dates and event times must not depend on the machine's zone.
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir.rstrip("/"))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = with_steps(check)
        return fn

    return register


def r4(*names: str) -> str:
    """``round(x, 4) as x`` for each name; greenness is exact on both sides."""
    return ", ".join(n if n in ("ndvi", "fuel") else f"round({n}, 4) as {n}" for n in names)
