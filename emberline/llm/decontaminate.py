"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of ten consecutive words of the normalised benchmark texts become the
patterns. Each document is normalised and scanned once; matches are mapped to
words and from there to byte ranges of the original text.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from emberline.llm.arrow import packed, unpacked, with_text_columns, without
from emberline.sources.writers import stored

#: A byte is part of a word if it is 0-9, a-z (A-Z once lowered) or not ASCII.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class LeakSpec:
    """``block_bytes`` bounds the pattern bytes of one automaton. A larger
    benchmark is held in several, each of which scans the texts in turn, so
    what is sent to the tasks at once never grows with the tables."""

    window: int = 10
    block_bytes: int = 16 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(words: list[bytes], n: int) -> list[bytes]:
    """Each n consecutive words; all of them if there are fewer."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))]


def windows(benchmark: DataFrame, spec: LeakSpec) -> DataFrame:
    """(block, window, ids): the distinct windows of all items with the items
    that have them, written to the shared folder. A block holds at most about
    ``block_bytes`` of them: windows are numbered by hash into as many blocks as
    their bytes ask for. A null text has no window; a null id is the empty string."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    each = with_text_columns(items, "windows array<binary>", lambda: lambda text: (windows_of(words_of(text), spec.window),))
    found = each.select("id", F.explode("windows").alias("window")).groupBy("window").agg(F.collect_set("id").alias("ids"))
    found = stored(found, "windows")
    size = F.octet_length("window") + F.aggregate("ids", F.lit(0), lambda n, i: n + F.octet_length(i))
    whole = found.agg(F.sum(size)).head()[0] or 0
    count = -(-whole // spec.block_bytes)
    return found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(max(1, count))))


def _automaton(block: dict[bytes, set[str]]):
    found = ahocorasick.Automaton()
    for window, ids in block.items():
        found.add_word(window.decode("latin-1"), (len(window), tuple(sorted(ids))))
    found.make_automaton()
    return found


def _scan(automaton, text: str | None) -> tuple:
    if not text:
        return 0, 0, [], []
    raw = text.encode("utf-8", "surrogatepass")
    normal = raw.translate(NORMAL)
    words = normal.split()
    if not words:
        return 0, 0, [], []
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    matches = list(automaton.iter(joined))
    if not matches:
        return len(words), 0, [], []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(lengths + 1)])  # the space before each word, and the last
    steps = np.zeros(len(words) + 1, np.int64)
    ids: set[str] = set()
    for end, (length, items) in matches:
        steps[np.searchsorted(at, end - length + 1)] += 1
        steps[np.searchsorted(at, end)] -= 1
        ids.update(items)
    hit = np.cumsum(steps[:-1]) > 0
    letters = np.frombuffer(normal, np.uint8) != 32
    edge = np.diff(np.concatenate([[0], letters.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    runs = zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1)
    return len(words), int(hit.sum()), sorted(ids), [(int(starts[a]), int(ends[b])) for a, b in runs]


def _merge(rows: list[tuple], text: str | None) -> tuple:
    """Results of several automata for one text as one result."""
    if len(rows) == 1:
        return rows[0]
    spans: list[tuple[int, int]] = []
    raw = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)
    for start, end in sorted(s for r in rows for s in r[3]):
        # Runs of neighbouring words are one run.
        if spans and not raw[spans[-1][1] : start].strip(b" "):
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((start, end))
    hit = sum(len(raw[a:b].split()) for a, b in spans)
    return rows[0][0], hit, sorted({i for r in rows for i in r[2]}), spans


def contamination(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """The rows of ``docs`` with words, hit words, the items found and the hit
    byte ranges (UTF-8, end exclusive) of the original text.

    Null and empty texts have no words and no hits; an empty benchmark hits
    nothing. Repeated rows are scanned row by row, items that repeat a text
    are all reported. Columns of the same names are replaced.
    """
    names = StructType.fromDDL(SCHEMA).names
    docs = without(docs, names)
    parts = windows(benchmark, spec)
    numbers = sorted(r[0] for r in parts.select("block").distinct().collect())
    if not numbers:
        return with_text_columns(docs, SCHEMA, lambda: lambda text: (len(words_of(text)), 0, [], []))
    if len(numbers) == 1:
        return with_text_columns(docs, SCHEMA, _scanner(_sent(parts, numbers[0])))
    kind = StructType.fromDDL(SCHEMA)
    rows = packed(docs).withColumn("found", F.lit(None).cast(kind))
    for number in numbers:
        # Each block is sent, scanned and dropped before the next one.
        block = _sent(parts, number)
        both = rows.withColumn("both", F.struct("text", "found")).drop("found")
        rows = with_text_columns(both, StructType([StructField("found", kind)]), _adder(block), text="both").drop("both")
        if number != numbers[-1]:
            rows = stored(rows, "leaks")
            block.destroy()
    return unpacked(rows, docs.columns, *[F.col("found")[n].alias(n) for n in names])


def _sent(parts: DataFrame, number: int):
    """One block as {window: item ids}, sent to all tasks; its size is bounded
    by ``block_bytes``, whatever that of the benchmark is."""
    rows = parts.where(F.col("block") == number).select("window", "ids").collect()
    return parts.sparkSession.sparkContext.broadcast({bytes(r["window"]): set(r["ids"]) for r in rows})


def _scanner(block):
    def setup():
        automaton = _automaton(block.value)
        return lambda text: _scan(automaton, text)

    return setup


def _adder(block):
    """Scans a text and adds what earlier blocks found in it."""

    def setup():
        automaton = _automaton(block.value)

        def of(both):
            now, old = _scan(automaton, both["text"]), both["found"]
            if old is None:
                return (now,)
            before = (old["n_words"], old["n_hit"], old["item_ids"], [(x["start"], x["end"]) for x in old["spans"]])
            return (_merge([before, now], both["text"]),)

        return of

    return setup


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
