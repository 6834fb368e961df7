"""Adds columns that are computed from whole texts in Arrow batches."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows whose texts are held as Python objects at one time.
ROWS_AT_ONCE = 256


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, as
    ``--py-files`` does. The archive is made on the driver, which serves it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp()
        context.addPyFile(shutil.make_archive(f"{folder}/emberline", "zip", root, "emberline"))
        _shipped.add(context.applicationId)


def without(df: DataFrame, names) -> DataFrame:
    """Drops columns of these names, whatever their case, so new ones can take them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, keys: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The keys, and all other columns in one called _rest, so that none of
    them meets a column that an operator makes on the way."""
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in keys]
    return df.select(*keys, F.struct(F.lit(None).cast("byte").alias("c"), *others).alias("_rest"))


def unpacked(df: DataFrame, columns: Sequence[str], *more, keys: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """``columns`` as they were before ``packed``, and ``more``."""
    return df.select(*[F.col(c) if c in keys else F.col("_rest").getField(f"c{i}").alias(c) for i, c in enumerate(columns)], *more)


def with_text_columns(
    df: DataFrame,
    schema: str | StructType,
    setup: Callable[[], Callable[[str | None], tuple]],
    text: str = "text",
    read: Callable[[pa.Scalar], object] = lambda value: value.as_py(),
) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, computed from ``text``.

    ``setup`` runs once a task and returns the function of one text; that
    function gets None for null and returns one value for each new column.
    ``read`` makes a Python value of an Arrow one. Columns of the same name are replaced. Nothing is shuffled.
    """
    if not isinstance(schema, StructType):
        schema = StructType.fromDDL(schema)
    ship_package(df.sparkSession)
    kept = without(df, schema.names)
    if text not in kept.columns:
        raise ValueError(f"column {text} is read and can't be replaced")
    out = StructType([*kept.schema.fields, *schema.fields])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = setup()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                rows = [of(read(t)) for t in batch.column(batch.schema.get_field_index(text))]
                columns = [*batch.columns, *[pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[n for n, _ in kinds]])

    return kept.mapInArrow(run, out)
