"""Quality classifier: a sparse ensemble of rules.

Boosted trees over text statistics give conjunctive rules (their paths); a
lasso logistic regression weighs the rules and leaves most out; what remains is
compiled into one Column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.arrow import with_text_columns, without
from emberline.llm.quality_rules import labelled_sample
from emberline.llm.trees import paths, plain_trees
from emberline.llm.words import code_points, run_hashes, span_hashes, word_bounds

STATISTICS = (
    "words", "mean_word", "longest_word", "upper", "digits", "marks", "symbols", "shouts", "bars", "other",
    "lines", "mean_line", "equal_lines", "distinct_words", "top_word", "again_next", "again_three", "full_stops",
    "capital_words", "symbol_words",
)


@dataclass(frozen=True)
class EnsembleSpec:
    """``fit_rows`` bounds the labelled rows of the fit, the only bound."""

    fit_rows: int = 8000
    trees: int = 15
    depth: int = 3
    lasso: float = 0.002
    predict_from: float = 0.3


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS; all 0 for null, empty and blank texts."""
    points = code_points(text or "")
    starts, ends = word_bounds(points)
    n = len(starts)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = int((ends - starts).sum())
    ascii_ = np.bincount(np.minimum(points, 128), minlength=129)
    lengths = ends - starts
    words = span_hashes(points, starts, ends)
    _, counts = np.unique(words, return_counts=True)
    three = np.unique(run_hashes(words, 3), return_counts=True)[1]
    lines = [line for line in text.split("\n") if line.strip()]
    upper = int(ascii_[65:91].sum())
    symbols = int(sum(ascii_[ord(c)] for c in "#$%&*"))
    last = points[ends - 1]
    first = points[starts]
    return [
        math.log1p(n),
        chars / n,
        math.log1p(int(lengths.max())),
        upper / chars,
        int(ascii_[48:58].sum()) / chars,
        int(sum(ascii_[ord(c)] for c in ".,;:?'\"()-")) / chars,
        symbols / chars,
        int(ascii_[33]) / chars,
        int(ascii_[ord("|")] + ascii_[ord("<")] + ascii_[ord(">")]) / chars,
        int(ascii_[128]) / chars,
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        len(counts) / n,
        int(counts.max()) / n,
        int((words[1:] == words[:-1]).sum()) / n,
        float(three[three > 1].sum()) / n,
        int((last == 46).sum()) / n,
        int(((first >= 65) & (first <= 90)).sum()) / n,
        int(np.isin(last, [ord(c) for c in "#$%&*!"]).sum()) / n,
    ]


Rule = tuple[tuple[int, bool, float], ...]


def _holds(rule: Rule, stats: Column) -> Column:
    tests = [stats[i] <= F.lit(t) if at_most else stats[i] > F.lit(t) for i, at_most, t in rule]
    return reduce(lambda a, b: a & b, tests)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``expression`` is all there is to apply them."""

    rules: tuple[tuple[float, Rule], ...]
    intercept: float

    def expression(self, stats: Column) -> Column:
        margin = F.lit(self.intercept)
        for weight, rule in self.rules:
            margin = margin + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def described(self) -> list[str]:
        return [
            f"{weight:+.3f} if " + " and ".join(f"{STATISTICS[i]} {'<=' if low else '>'} {t:.4g}" for i, low, t in rule)
            for weight, rule in sorted(self.rules, key=lambda r: -abs(r[0]))
        ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return with_text_columns(docs, "statistics array<double>", lambda: lambda t: (statistics(t),), text=text)


def fit(docs: DataFrame, labels: DataFrame, spec: EnsembleSpec = EnsembleSpec()) -> RuleModel | None:
    """Learns from labelled documents whose crc32 of doc_id, as text, isn't a
    multiple of five; only statistics of texts are inputs. None if there is
    nothing to tell apart."""
    seen = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    rows = with_statistics(labelled_sample(docs, seen, spec.fit_rows)).select("label", "statistics").persist()
    try:
        sides = rows.groupBy("label").count().collect()
        if len(sides) < 2:
            return None
        known = rows.select("label", "statistics", array_to_vector("statistics").alias("features"))
        boosted = GBTClassifier(maxIter=spec.trees, maxDepth=spec.depth, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(known)
        found = Counter(rule for _, tree in plain_trees(boosted) for rule in paths(tree))
        rules = sorted(found)
        if not rules:
            return None
        holds = F.array(*[_holds(rule, F.col("statistics")).cast("double") for rule in rules])
        marked = known.select("label", array_to_vector(holds).alias("features"))
        lasso = LogisticRegression(maxIter=60, regParam=spec.lasso, elasticNetParam=1.0, standardization=False).fit(marked)
        weights = lasso.coefficients.toArray()
        return RuleModel(tuple((float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-9), float(lasso.intercept))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: RuleModel | None, spec: EnsembleSpec = EnsembleSpec()) -> DataFrame:
    """The rows of ``docs`` with ``statistics``, ``score`` and ``predicted``.

    Null and empty texts have statistics of 0 and are scored like any other.
    Without a model the score is 0.5. Rows are scored one by one, so repeated
    rows and ids don't matter; columns of the same names are replaced.
    """
    docs = with_statistics(without(docs, ["score", "predicted"]))
    value = F.lit(0.5) if model is None else model.expression(F.col("statistics"))
    return docs.withColumn("score", value).withColumn("predicted", (F.col("score") >= spec.predict_from).cast("int"))


def digest(scored: DataFrame) -> DataFrame:
    # The remainder of a null id counts as 0.
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
