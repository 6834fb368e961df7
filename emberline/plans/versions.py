"""A table by date that is read in whole versions.

    files/version=N/date=D    the dates that version N wrote
    ledger/N                  one row a date: which version has its files, and
                              which input batches they were made of

A version writes only the dates that changed and takes all others over by
their ledger rows. Its ledger is written last; a version exists once Spark has
committed that. So a reader has one whole version, the newest or any older one,
while the next is being written, and what a failed write left is replaced by
the next. One process writes at a time. The ledger has a short row for each
calendar day, whatever the data volume.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.sources.readers import child_names, folders_like, path_exists


class StateNotReady(RuntimeError):
    """Raised when the state is read before the first refresh."""


class VersionedDates:
    """``inputs`` names the columns of the ledger besides date and version."""

    def __init__(self, base: str, inputs: tuple[str, ...] = ()):
        self.base, self.inputs = base.rstrip("/"), inputs

    def numbers(self, spark: SparkSession) -> list[int]:
        """All versions, oldest first."""
        names = [int(n) for n in child_names(spark, f"{self.base}/ledger") if n.isdigit()]
        return sorted(n for n in names if path_exists(spark, f"{self.base}/ledger/{n}/_SUCCESS"))

    def ledger(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """(date, version, inputs...) of a version, the newest if none is named."""
        known = self.numbers(spark)
        if not known or (version is not None and version not in known):
            raise StateNotReady("no zone state yet: run a refresh first" if version is None else f"there is no version {version}")
        fields = ", ".join(["date DATE", "version LONG", *[f"{i} LONG" for i in self.inputs]])
        return spark.read.schema(fields).parquet(f"{self.base}/ledger/{known[-1] if version is None else version}")

    def read(self, spark: SparkSession, version: int | None = None, dates: Iterable[dt.date] | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; only files of
        ``dates`` are opened if they are given."""
        rows = self.ledger(spark, version).where("version is not null")
        if dates is not None:
            rows = rows.where(F.col("date").isin(list(dates)))
        folders = [f"{self.base}/files/version={r['version']}/date={r['date']}" for r in rows.collect()]
        if not folders:
            raise StateNotReady("no zone state for these dates")
        return spark.read.option("basePath", f"{self.base}/files").parquet(*folders).drop("version")

    def write(self, rows: DataFrame, touched: dict[dt.date, dict[str, int]]) -> int:
        """A new version in which ``rows`` replace those of the ``touched``
        dates, whose ledger entries get the given input batches. A touched date
        without rows has none in the new version."""
        spark = rows.sparkSession
        known = self.numbers(spark)
        number = known[-1] + 1 if known else 1
        target = f"{self.base}/files/version={number}"
        # A date goes to one task or, if it is large, to a few.
        rows.hint("rebalance", F.col("date")).write.mode("overwrite").partitionBy("date").parquet(target)
        filled = {p.rsplit("/date=", 1)[1] for p in folders_like(spark, f"{target}/date=*")}
        names = ["date", "version", *self.inputs]
        entries = {r["date"]: r.asDict() for r in self.ledger(spark).collect()} if known else {}
        for day, batches in touched.items():
            old = entries.get(day, dict.fromkeys(names))
            entries[day] = {**old, "date": day, "version": number if str(day) in filled else None, **batches}
        fields = ", ".join(["date DATE", "version LONG", *[f"{i} LONG" for i in self.inputs]])
        values = [tuple(entries[day][n] for n in names) for day in sorted(entries)]
        ledger = spark.createDataFrame(values, fields).coalesce(1).write.mode("overwrite")
        ledger.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(f"{self.base}/ledger/{number}")
        return number
