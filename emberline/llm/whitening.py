"""Whitening of embeddings by polarisation.

Entries become whole numbers, so every sum is exact. For each dimension i and
each pair i < j the squares of the centred values of x_i and of x_i + x_j are
added up; as var(x_i + x_j) = var(x_i) + var(x_j) + 2 cov(x_i, x_j), their
differences are all cross-covariances. The matrix goes to ``eigh``; its first
eigenvectors project the rows.

What a task keeps is one matrix of the dimensions squared, and what reaches the
driver is one number (in parts) for each pair of dimensions, however many rows
there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType, DecimalType

from emberline.llm.arrow import fresh, ship_package, without
from emberline.sources.writers import stored

#: Values are squared in parts of so many bits: products of two parts, added
#: over ROWS rows, stay below 2^62.
PART = 24
ROWS = 2048


@dataclass(frozen=True)
class WhitenSpec:
    """``scale``: steps of the whole numbers a unit; ``components``: how many
    are returned; ``dimensions``: None takes the length that most rows have."""

    scale: int = 256
    components: int = 4
    dimensions: int | None = None


@dataclass(frozen=True)
class Whitening:
    """``sums`` of the ``n`` distinct vectors, unit ``axes`` (one a row) by
    falling ``eigenvalues``, and the ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; as Python integers if 64 bits may not hold it."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened components of centred rows; not-a-number along an axis on
        which nothing varies."""
        spread = np.where(self.eigenvalues > self.least, self.eigenvalues, np.nan)
        return (z.astype(np.float64) / self.n) @ self.axes.T / np.sqrt(spread)

    @property
    def least(self) -> float:
        """Eigenvalues up to here are rounding."""
        return self.trace * len(self.sums) * np.finfo(np.float64).eps


def whole_numbers(vector: Column, spec: WhitenSpec) -> Column:
    """floor(scale * entry) of each entry; null where the row doesn't count."""
    # Beyond 2^53 / scale a double has no fraction and its long may overflow.
    bound = float(1 << 53) / spec.scale
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < bound, F.lit(False)))
    return F.when(good & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * float(spec.scale))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            yield _matrix(whole.slice(start, ROWS).column(0), size)


def _parts(w: np.ndarray, count: int) -> list[np.ndarray]:
    """w as ``count`` parts of PART bits, lowest first; the last has the sign."""
    out = []
    for _ in range(count - 1):
        out.append((w & ((1 << PART) - 1)).astype(np.int64))
        w = w >> PART
    return [*out, w.astype(np.int64)]


def _sums(fit: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows, and the sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * size
        for x in _blocks(batches, size):
            n += len(x)
            # Entries are below 2^53; halves of 26 bits can't overflow.
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            total = [t + (int(h) << 26) + int(v) for t, h, v in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["n", "total"]
        )

    rows = fit.mapInArrow(run, "n long, total array<decimal(38,0)>")
    sums = rows.select("n", F.posexplode("total").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = {r["i"]: r for r in sums.collect()}  # one row a dimension
    if not found or not found[0]["n"]:
        return 0, ()
    return found[0]["n"], tuple(int(found[i]["s"]) for i in range(size))


def polarised(fit: DataFrame, n: int, sums: tuple[int, ...]) -> DataFrame:
    """(i, j, shift, total): the squares of the centred values of dimension i
    (i = j) or of the sum of dimensions i and j (i < j), added up over all
    rows, are the sum of total * 2^shift."""
    size = len(sums)
    centre = Whitening(n, sums, np.zeros((0, size)), np.zeros(0), 0.0)
    reach = F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))
    most = int(fit.agg(reach).head()[0] or 0)
    bits = (2 * (most * n + max(map(abs, sums)))).bit_length()
    count = max(1, -(-bits // PART))
    kinds = [(k, m) for k in range(count) for m in range(k, count)]

    def run(batches):
        total = np.zeros((len(kinds), size, size), object)
        for x in _blocks(batches, size):
            z = centre.centred(x)
            for i in range(size):
                w = z[:, i:] + z[:, i : i + 1]
                w[:, 0] = z[:, i]
                parts = _parts(w, count)
                for at, (k, m) in enumerate(kinds):
                    total[at, i, i:] += np.einsum("ij,ij->j", parts[k], parts[m]) * (1 if k == m else 2)
        for at, (k, m) in enumerate(kinds):
            i, j = np.triu_indices(size)
            values = [Decimal(int(v)) for v in total[at][i, j]]
            shift = np.full(len(i), PART * (k + m), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(shift), pa.array(values, pa.decimal128(38, 0))],
                names=["i", "j", "shift", "total"],
            )

    rows = fit.mapInArrow(run, "i int, j int, shift int, total decimal(38,0)")
    return rows.groupBy("i", "j", "shift").agg(F.sum("total").alias("total"))


def covariance(squares: dict[tuple[int, int], int], n: int, size: int) -> np.ndarray:
    """The covariance matrix from the exact sums of squares of n * x - S."""
    v = np.zeros((size, size))
    for (i, j), q in squares.items():
        twice = 2 * q if i == j else q - squares[i, i] - squares[j, j]
        v[i, j] = v[j, i] = twice / (2 * n**3)  # integers, so rounded once
    return v


def fit_list(df: DataFrame, vector: str = "embedding", spec: WhitenSpec = WhitenSpec()) -> tuple[DataFrame, int]:
    """The distinct whole-number vectors ``x`` of the rows that count, written
    to the shared folder, and their dimensions (0 if there are none)."""
    found = df.select(whole_numbers(F.col(vector), spec).alias("x")).where("x is not null")
    size = spec.dimensions
    if size is None:
        lengths = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
        size = lengths["size"] if lengths else 0
    # Copies meet in the tasks that read them, so a common vector moves once a task.
    return stored(found.where(F.size("x") == size).distinct(), "whitening_fit"), size


def fit(vectors: DataFrame, size: int, spec: WhitenSpec = WhitenSpec()) -> Whitening | None:
    """From the table of ``fit_list``; None if it is empty."""
    ship_package(vectors.sparkSession)
    n, sums = _sums(vectors, size) if size else (0, ())
    if not n:
        return None
    squares: dict[tuple[int, int], int] = {}
    for r in polarised(vectors, n, sums).collect():  # bounded by the dimensions squared
        squares[r["i"], r["j"]] = squares.get((r["i"], r["j"]), 0) + (int(r["total"]) << r["shift"])
    v = covariance(squares, n, size)
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[: spec.components]
    axes = axes[:, order].T
    heads = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return Whitening(n, sums, axes * np.sign(heads)[:, None], e[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors
    minus the identity, measured on all of them; axes on which nothing varies
    don't count. Rows are centred exactly before they are multiplied."""
    size, k = len(model.sums), len(model.axes)

    def run(batches):
        total = np.zeros((k, k))
        for x in _blocks(batches, size):
            w = model.project(model.centred(x))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "total"]
        )

    sums = {r["at"]: r["s"] for r in vectors.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("s")).collect()}
    apart = np.abs(np.array([sums[i] for i in range(k * k)]).reshape(k, k) / model.n - np.eye(k))
    varied = model.eigenvalues > model.least
    return float(apart[varied][:, varied].max()) if varied.any() else None


COLUMNS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(df: DataFrame, vector: str = "embedding", spec: WhitenSpec = WhitenSpec()) -> DataFrame:
    """The rows of ``df`` that count, once for each component, with
    ``component`` (from 1 by falling eigenvalue), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    A row does not count if its vector is null, empty, of another length than
    most rows have (ties: the longer), or holds a null, a non-finite entry or
    one of 2^53 / scale and more. Repeated rows are all returned but fitted
    once. ``whitened`` is null along an axis on which nothing varies, and so is
    ``explained`` if nothing varies at all. ``deviation`` is a decimal of 38
    digits and null beyond. Fewer dimensions than components give fewer rows,
    an empty table gives none. Columns of the same names are replaced, all
    others stay.
    """
    df = without(df, COLUMNS)
    vectors, size = fit_list(df, vector, spec)
    model = fit(vectors, size, spec)
    error = identity_error(vectors, model) if model else None
    x, out = fresh(df, "_x"), fresh(df, "_white")
    rows = df.withColumn(x, whole_numbers(F.col(vector), spec)).where(F.size(x) == size) if model else df.where("false").withColumn(x, F.lit(None).cast("array<bigint>"))
    each = ArrayType(
        StructType([StructField("component", IntegerType()), StructField("deviation", DecimalType(38, 0)), StructField("whitened", DoubleType())])
    )

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                z = model.centred(_matrix(batch.column(batch.schema.get_field_index(x)), size))
                white = model.project(z)
                deviation = [Decimal(d) if d < 10**38 else None for d in _squares(z)]
                values = [
                    [{"component": c + 1, "deviation": d, "whitened": None if np.isnan(v) else float(v)} for c, v in enumerate(w)]
                    for d, w in zip(deviation, white)
                ]
                kind = pa.list_(pa.struct([("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, out])

    found = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, each)]))
    n = F.lit(model.n if model else None).cast("long")
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.eigenvalues] if model else [F.lit(None).cast("double")])
    one = fresh(df, "_one")
    return found.withColumn(one, F.explode(out)).select(
        *df.columns,
        F.col(one)["component"].alias("component"),
        n.alias("n"),
        F.col(one)["deviation"].alias("deviation"),
        F.col(one)["whitened"].alias("whitened"),
        F.element_at(shares, F.col(one)["component"]).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _squares(z: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = int(np.abs(z).max(initial=0))
    if most * most * z.shape[1] < 1 << 62:
        return (z * z).sum(axis=1).tolist()
    return (z.astype(object) ** 2).sum(axis=1).tolist()


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
