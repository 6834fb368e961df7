"""Substring dedup by sliding spans of sentences.

Every run of three consecutive sentences, every run of two that have at least
twenty words, and every single sentence of at least forty, is hashed. Equal hashes are joined over all documents;
sentences that a run covers which isn't the first of its kind are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import packed, unpacked, with_text_columns, without
from emberline.llm.words import code_points, lower_ascii, span_hashes, word_bounds
from emberline.sources.writers import stored


@dataclass(frozen=True)
class SpanSpec:
    """(sentences, least words) of the runs that are hashed."""

    runs: tuple[tuple[int, int], ...] = ((3, 0), (2, 20), (1, 40))


def sentences(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends. A sentence ends behind the white space that follows
    ``.``, ``!`` or ``?``, behind a line end, and where the text ends."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    stop = np.isin(points, [ord(c) for c in ".!?"])
    cut = points == 10
    cut[1:] |= space[1:] & stop[:-1]
    ends = np.unique(np.append(np.flatnonzero(cut) + 1, len(points)))
    return np.concatenate([[0], ends[:-1]]), ends


def runs_of(text: str | None, spec: SpanSpec = SpanSpec()) -> tuple[np.ndarray, ...]:
    """Hash, first sentence, last sentence (exclusive) of every run, and
    whether it is the first of its kind in the text. Sentences without a word
    are passed over."""
    points = lower_ascii(code_points(text or ""))
    starts, ends = sentences(points)
    at, to = word_bounds(points)
    words = span_hashes(points, at, to)
    first, behind = np.searchsorted(at, starts), np.searchsorted(at, ends)
    real = np.flatnonzero(behind > first)
    hashes, froms, tos = [], [], []
    for n, least in spec.runs:
        if len(real) < n:
            continue
        a, b = real[: len(real) - n + 1], real[n - 1 :]
        long = behind[b] - first[a] >= least
        a, b = a[long], b[long]
        hashes.append(span_hashes(words, first[a], behind[b]) ^ np.uint64(n))
        froms.append(a)
        tos.append(b + 1)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, np.zeros(0, bool)
    h, a, b = np.concatenate(hashes), np.concatenate(froms), np.concatenate(tos)
    new = np.zeros(len(h), bool)
    new[np.unique(h, return_index=True)[1]] = True  # runs of one kind are in order of place
    return h, a, b, new


def cut(text: str | None, repeated, spec: SpanSpec = SpanSpec()) -> tuple[str | None, int, int]:
    """The text without sentences that the runs of these numbers, or repeats
    inside the text, cover; number of sentences; number removed."""
    if not text:
        return text, 0, 0
    starts, ends = sentences(code_points(text))
    _, a, b, new = runs_of(text, spec)
    drop = ~new
    drop[np.asarray(repeated, np.int64)] = True
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, a[drop], 1)
    np.add.at(steps, b[drop], -1)
    gone = np.cumsum(steps[:-1]) > 0
    kept = "".join(text[s:e] for s, e, g in zip(starts.tolist(), ends.tolist(), gone.tolist()) if not g) if gone.any() else text
    return kept, len(starts), int(gone.sum())


def substring_dedup(docs: DataFrame, spec: SpanSpec = SpanSpec()) -> DataFrame:
    """The rows of ``docs`` with the text that is left, ``n_sentences`` and
    ``n_removed``.

    The first of equal runs is that of the smallest doc_id, then of the first
    place; a null id comes last. Rows that share an id are one document and
    are not held against each other. Null texts stay null; texts of fewer
    sentences than a run has stay as they are. Other columns stay, but for
    n_sentences and n_removed, which are replaced.
    """
    docs = without(docs, ["n_sentences", "n_removed"])

    def runs():
        def of(text):
            h, _, _, new = runs_of(text, spec)
            number = np.flatnonzero(new)
            return h[new].view(np.int64), number.astype(np.int32)

        return of

    hashed = with_text_columns(docs.select("doc_id", "text"), "hash array<long>, number array<int>", runs)
    spans = stored(
        hashed.select("doc_id", F.xxhash64("text").alias("_text"), F.arrays_zip("hash", "number").alias("runs")), "sentence_runs"
    ).select("doc_id", "_text", F.explode("runs").alias("r"))
    spans = spans.select("doc_id", "_text", F.col("r.hash").alias("hash"), F.col("r.number").alias("number"))
    common = spans.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("named"), F.count(F.lit(1)).alias("rows"))
    common = common.where("low < high or (low is not null and named < rows)").select("hash", "low")
    later = spans.join(common, "hash").where("doc_id is null or doc_id > low")
    marks = later.groupBy("doc_id", "_text").agg(F.collect_set("number").alias("_number"))
    marks = marks.toDF("of", "hash", "number")
    rows = packed(docs).withColumn("key", F.xxhash64("text"))
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("hash")), "left")
    # Text and marks go through Python together.
    out = out.select("doc_id", "_rest", F.struct("text", F.coalesce("number", F.array().cast("array<int>")).alias("number")).alias("both"))

    def cutter():
        return lambda both: cut(both["text"], both["number"], spec)

    done = with_text_columns(out, "left string, n_sentences long, n_removed long", cutter, text="both")
    return unpacked(done.withColumn("text", F.col("left")), docs.columns, "n_sentences", "n_removed")


def digest(left: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_sentences", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
