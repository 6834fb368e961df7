"""Quality rules: counts of words and lines, and a calibrated n-gram model.

The model is a logistic regression over hashed word and character n-grams. It
is trained on labelled rows, calibrated on rows that the fit did not see, and
applied in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from emberline.llm.arrow import with_text_columns
from emberline.llm.words import code_points, mixed, run_hashes, span_hashes, word_bounds
from emberline.sources.writers import stored

SYMBOLS = "#*$%&|<>"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class RulesSpec:
    """``fit_rows`` bounds the labelled rows that are used for the fit; it is
    the only bound, and scoring always covers all rows."""

    buckets: int = 1 << 13
    fit_rows: int = 6000
    iterations: int = 25
    penalty: float = 1e-3
    keep_from: float = 0.3
    least_words: int = 50
    most_repeated: int = 50


def base_counts(text: str | None, spec: RulesSpec = RulesSpec()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    if not text:
        return 0, 0, 0, 0, 0, True
    points = code_points(text)
    starts, ends = word_bounds(points)
    words = len(starts)
    symbols = int(np.isin(points, [ord(c) for c in SYMBOLS]).sum())
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            repeated += line in seen
            seen.add(line)
    covered = np.zeros(words, bool)
    if words >= 3:
        _, which, counts = np.unique(run_hashes(span_hashes(points, starts, ends), 3), return_inverse=True, return_counts=True)
        twice = counts[which] >= 2
        for k in range(3):
            covered[k : k + len(twice)] |= twice
    n_repeat = int(covered.sum())
    failed = words < spec.least_words or 100 * n_repeat > spec.most_repeated * words
    return words, int((ends - starts).sum()), symbols, repeated, n_repeat, failed


def ngram_families(text: str | None, buckets: int) -> list[np.ndarray]:
    """Bucket numbers of the word 1- and 2-grams and the character 2-, 3- and
    4-grams; each family has buckets of its own."""
    points = code_points(text or "")
    words = span_hashes(points, *word_bounds(points))
    grams = [words, run_hashes(words, 2)]
    grams += [run_hashes(mixed(points.astype(np.uint64) + np.uint64(1)), n) for n in (2, 3, 4)]
    return [(g % np.uint64(buckets)).astype(np.int64) + i * buckets for i, g in enumerate(grams)]


def _sparse(text: str | None, buckets: int) -> dict:
    """The shares of the buckets, as the fields of a sparse vector."""
    index, value = [np.zeros(0, np.int64)], [np.zeros(0)]
    for family in ngram_families(text, buckets):
        if len(family):
            at, n = np.unique(family, return_counts=True)
            index.append(at)
            value.append(n / len(family))
    return {"type": 0, "size": 5 * buckets, "indices": np.concatenate(index), "values": np.concatenate(value)}


@dataclass(frozen=True)
class RulesModel:
    """Weights by bucket, and the calibration of the margin."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float
    spec: RulesSpec

    def probability(self, text: str | None) -> float:
        margin = self.intercept
        for family in ngram_families(text, self.spec.buckets):
            if len(family):
                margin += float(self.weights[family].mean())
        z = self.slope * margin + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()})

    @staticmethod
    def from_json(text: str) -> RulesModel:
        x = json.loads(text)
        return RulesModel(np.array(x["weights"]), x["intercept"], x["slope"], x["offset"], RulesSpec(**x["spec"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, label: str = "quality") -> DataFrame:
    """(doc_id, text, label, part) of at most ``rows`` labelled documents.

    Taken in the order of a hash of doc_id, so it is spread evenly and is the
    same in every run. part, 0 to 4, is of another hash. Null ids and labels
    don't count; of several labels of a document the largest does.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # Bounded by ``rows``, hence the hint.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = joined.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))


def fit(docs: DataFrame, labels: DataFrame, spec: RulesSpec = RulesSpec()) -> RulesModel | None:
    """None if there is nothing to tell apart: no labelled row, or one label.

    The vectors of the bounded sample are stored as a table, so only the fit's
    own blocks are held in memory.
    """
    kind = StructType([StructField("features", VectorUDT())])
    sample = labelled_sample(docs, labels, spec.fit_rows).repartition(8, "doc_id")
    rows = with_text_columns(sample, kind, lambda: lambda text: (_sparse(text, spec.buckets),))
    rows = stored(rows.select("label", "part", "features"), "rules_sample")
    sides = {r["label"]: r for r in rows.groupBy("label").agg(F.min("part").alias("low"), F.max("part").alias("high")).collect()}
    if len(sides) < 2:
        return None
    apart = all(r["low"] == 0 and r["high"] > 0 for r in sides.values())
    plain = LogisticRegression(maxIter=spec.iterations, regParam=spec.penalty, standardization=True)
    model = plain.fit(rows.where("part > 0") if apart else rows)
    margin = array_to_vector(F.array(vector_to_array("rawPrediction")[1]))
    margins = model.transform(rows.where("part = 0") if apart else rows).select("label", margin.alias("features"))
    platt = LogisticRegression(maxIter=50, regParam=1e-3).fit(margins)
    return RulesModel(
        model.coefficients.toArray(), float(model.intercept), float(platt.coefficients[0]), float(platt.intercept), spec
    )


def quality_rules(docs: DataFrame, model: RulesModel | None, spec: RulesSpec = RulesSpec()) -> DataFrame:
    """The rows of ``docs`` with their counts, ``probability`` and ``kept``.

    Null and empty texts have no words and fail. Repeated rows and ids are
    scored row by row. Columns of the same names are replaced, all others
    stay. Without a model the probability is null and the counts decide.
    """

    def setup():
        def of(text):
            counts = base_counts(text, spec)
            p = None if model is None else model.probability(text)
            return *counts, p, not counts[-1] and (p is None or p >= spec.keep_from)

        return of

    return with_text_columns(docs, BASE_SCHEMA + ", probability double, kept boolean", setup)
