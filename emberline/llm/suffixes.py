"""Exact substring dedup: bytes of strings that start in more than one place.

Suffixes are sorted with a difference cover, only as deep as the length asks
and only where a repeat is possible:

1. Anchors. In every window of ``length`` bytes one gram is the smallest by
   hash; equal windows have it in the same place. Windows whose gram is found
   once can't repeat. An anchor whose whole served stretch is found twice is
   settled as it is. Both are counts of 64-bit hashes, with partial sums before
   each exchange.
2. Blocks. What is left, the stretches where repeats begin and end, is cut into
   blocks of sixteen neighbouring starts, placed relative to the anchor. The
   bytes that all sixteen windows share are the core, eight triples of symbols.
   Blocks that are the same wherever their core is found are settled by hashes,
   too; only the others go on to the next steps.
3. Sort the sampled triples, name them by their order, and recurse on the names
   (eight names, then three, then one) until a name stands for a core. Names
   ascend as the cores do.
4. Merge: each remaining suffix is the few bytes before its core, the core's
   name and the bytes behind it. Suffixes of one place in the block are ordered
   by these in range partitions, and neighbours in that order that are equal in
   all ``length`` bytes are repeated strings.

Hashes only choose which suffixes enter the order, and stand for copies of whole
stretches and blocks. No step gathers a group: names are given by range
partitions, and equal suffixes may lie in several of them.

Beside that, each text's strings of ``gram`` bytes that are the smallest of a
window of ``noted`` bytes are held against those of all others. They say which
documents share a passage that is shorter than ``length``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from emberline.llm.arrow import ROWS_AT_ONCE, packed, ship_package, unpacked, with_text_columns, without
from emberline.llm.words import _power, mixed
from emberline.sources.writers import stored

BLOCK = 16
SYMBOL = 16


@dataclass(frozen=True)
class SuffixSpec:
    """``length`` bytes that count as a repeat; ``gram`` bytes of an anchor;
    ``noted`` bytes of a shared passage that is noted but stays."""

    length: int = 400
    gram: int = 128
    noted: int = 240

    def __post_init__(self):
        if not BLOCK < self.gram < self.noted <= self.length < 1 << 16:
            raise ValueError("16 < gram < noted <= length < 65536")

    @property
    def core(self) -> int:
        return self.length - BLOCK


def _running(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    return total


def _hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((total[ends] - total[starts]) * _power("down", len(total))[starts])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    size, step, out = len(values) - width + 1, 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return out[:size] if step == width else np.minimum(out[:size], out[width - step : width - step + size])


def _least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbours; the first of equals."""
    low = np.uint64(0xFFFFFFFF)
    place = np.arange(len(grams), dtype=np.uint64)
    return (_least((grams & ~low) | place, width) & low).astype(np.int64)


def anchors(raw: bytes, spec: SuffixSpec) -> tuple[np.ndarray, ...]:
    """gram hash, stretch hash, first start, number of starts, place of the
    gram; one of each for every run of starts that share an anchor. Then the
    hashes of the noted grams."""
    empty = np.zeros(0, np.int64)
    none = empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    if len(raw) < spec.noted:
        return *none, empty.astype(np.uint64)
    total = _running(np.frombuffer(raw, np.uint8))
    place = np.arange(len(raw) - spec.gram + 1)
    grams = _hashes(total, place, place + spec.gram)
    noted = grams[np.unique(_least_grams(grams, spec.noted - spec.gram + 1))]
    if len(raw) < spec.length:
        return *none, noted
    at = _least_grams(grams, spec.length - spec.gram + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.append(first[1:] - 1, len(at) - 1)
    chosen = at[first]
    stretch = _hashes(total, first, last + spec.length)
    stretch ^= mixed(((chosen - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64))
    return grams[chosen], stretch, first, last - first + 1, chosen, noted


def _blocks(raw: bytes, offset: int, starts: int, spec: SuffixSpec):
    """(block, from, to, core, head, tail) of a stretch. ``offset``: of the anchor in
    ``raw``, which begins at the first of ``starts``; from and to bound the
    starts inside the block, head and tail stand around the core."""
    n = 0
    while n < starts:
        block = (n - offset) // BLOCK
        begin = offset + block * BLOCK
        to = min(starts - 1, begin + BLOCK - 1)
        head = raw[n : begin + BLOCK]
        core = raw[begin + BLOCK : begin + spec.length]
        tail = raw[begin + spec.length : to + spec.length]
        yield block, n - begin, to - begin, core, head, tail
        n = to + 1


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _rows_from(df: DataFrame, schema: str, of) -> DataFrame:
    """One row for each tuple that ``of`` yields for a row's values."""
    ship_package(df.sparkSession)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                rows = [row for values in whole.slice(start, ROWS_AT_ONCE).to_pylist() for row in of(values)]
                arrays = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in kinds])

    return df.mapInArrow(run, schema)


def _named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``name``: a number in the order of the columns, equal for
    equal values. Range partitions sort apart from each other; the number's
    high bits are the partition."""
    ordered = rows.select(*columns).distinct().sort(*columns)
    names = stored(ordered.withColumn("name", F.monotonically_increasing_id()), "triple_names")
    return rows.join(names.hint("merge"), columns)


def core_names(cores: DataFrame, spec: SuffixSpec) -> DataFrame:
    """(piece, name) for (piece, core): equal names for equal cores."""
    width = 3 * SYMBOL

    def triples(row):
        for i in range(0, spec.core, width):
            yield row["piece"], i // width, row["core"][i : i + width]

    level = _rows_from(cores, "piece long, n int, a binary", triples)
    named = _named(level, ["a"])
    count = -(-spec.core // width)
    while count > 1:
        # Names of three neighbours become the next triple; missing ones are -1.
        held = named.groupBy("piece", F.floor(F.col("n") / 3).cast("int").alias("n")).agg(
            *[F.max(F.when(F.col("n") % 3 == i, F.col("name")).otherwise(-1)).alias(c) for i, c in enumerate("abc")]
        )
        named = _named(stored(held, "next_triples"), ["a", "b", "c"])
        count = -(-count // 3)
    return named.select("piece", "name")


def merged(starts: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """``starts`` in the order of ``keys``, with ``part``, the range that a row
    is in, and ``row``, its number there. ``rest`` spreads equal rows."""
    ordered = starts.repartitionByRange(*keys, *rest).sortWithinPartitions(*keys, *rest)
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    return stored(ordered, "merged_starts")


def with_equal_neighbour(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``merged`` whose neighbour in the order has the same keys.
    At the border of two ranges the last row of the one and the first of the
    next are neighbours."""
    key = F.struct(*keys)
    inside = Window.partitionBy("part").orderBy("row")
    rows = ordered.withColumn("key", key).withColumn("before", F.lag("key").over(inside)).withColumn("behind", F.lead("key").over(inside))
    # One row a range.
    ends = ordered.groupBy("part").agg(F.min_by(key, F.col("row")).alias("first"), F.max_by(key, F.col("row")).alias("last"))
    along = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("next_first"))
    rows = rows.join(ends, "part")
    equal = (F.coalesce("before", "last_before") == F.col("key")) | (F.coalesce("behind", "next_first") == F.col("key"))
    return rows.where(equal).select(*ordered.columns)


def noted_anchors(docs: DataFrame, spec: SuffixSpec) -> DataFrame:
    """(_doc, gram, stretch, at, noted) of each row, written to the shared folder."""

    def of(text):
        gram, stretch, first, starts, place, noted = anchors((text or "").encode("utf-8", "surrogatepass"), spec)
        where = (first << 32) | (starts << 16) | (place - first)
        return gram.view(np.int64), stretch.view(np.int64), where, noted.view(np.int64)

    named = docs.select("text", F.xxhash64("doc_id", "text").alias("_doc"))
    schema = "gram array<long>, stretch array<long>, at array<long>, noted array<long>"
    return stored(with_text_columns(named, schema, lambda: of).drop("text"), "anchors")


def shared_strings(held: DataFrame) -> DataFrame:
    """(_doc, n_shared): how many noted strings of a row stand elsewhere, too."""
    notes = held.select("_doc", F.explode("noted").alias("noted"))
    several = notes.groupBy("noted").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("noted")
    return notes.join(several, "noted").groupBy("_doc").agg(F.count_distinct("noted").alias("n_shared"))


def repeated_starts(docs: DataFrame, held: DataFrame, spec: SuffixSpec) -> DataFrame:
    """(_doc, first, last) of the starts of repeated strings, in runs. _doc
    tells rows apart by id and text; equal rows have equal runs."""
    zipped = F.explode(F.arrays_zip("gram", "stretch", "at"))
    places = held.select("_doc", zipped.alias("z")).select("_doc", "z.*")

    counts = stored(places.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n")), "stretches")
    mixed_ = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    mixed_ = mixed_.where("kinds > 1 and least = 1").select("gram", F.lit(True).alias("open"))
    # An anchor found once, or always in one stretch, needs no more than the count.
    wanted = counts.join(mixed_, "gram", "left").where("n > 1 or open").select("gram", "stretch", "n", F.coalesce("open", F.lit(False)).alias("open"))
    # First start, number of starts and place of the gram travel as one long.
    small = F.lit(0xFFFF)
    numbers = {
        "first": F.shiftright("at", 32).cast("int"),
        "starts": F.shiftright("at", 16).bitwiseAND(small).cast("int"),
        "offset": F.col("at").bitwiseAND(small).cast("int"),
    }
    marked = places.join(wanted, ["gram", "stretch"]).withColumns(numbers).drop("at")
    marked = stored(marked, "marked_anchors")
    whole = marked.where("n > 1").select("_doc", "first", (F.col("first") + F.col("starts") - 1).alias("last"))

    # One stretch of each kind stands for all of them.
    kinds = marked.where("open").groupBy("gram", "stretch").agg(
        F.max("n").alias("n"), F.min(F.struct("_doc", "first", "starts", "offset")).alias("at")
    )
    spots = kinds.groupBy("at._doc").agg(
        F.collect_list(F.struct("gram", "n", "at.first", "at.starts", "at.offset")).alias("spots")
    )
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("_doc")).where("text is not null")

    def cut(row):
        raw = row["text"].encode("utf-8", "surrogatepass")
        for s in row["spots"]:
            yield row["_doc"], s["gram"], s["n"], s["first"], s["starts"], s["offset"], raw[s["first"] : s["first"] + s["starts"] - 1 + spec.length]

    both = texts.join(spots.hint("merge"), "_doc").select("_doc", "text", "spots")
    pieces = _rows_from(both, "_doc long, gram long, n long, first int, starts int, offset int, raw binary", cut)
    pieces = pieces.dropDuplicates(["_doc", "gram", "first"]).withColumn("piece", F.monotonically_increasing_id())
    pieces = stored(pieces, "stretch_texts")

    def hashed(row):
        for block, low, high, core, head, tail in _blocks(row["raw"], row["offset"], row["starts"], spec):
            yield row["piece"], row["gram"], block, _hash64(core), _hash64(b"%d %d " % (low, high) + head + core + tail)

    # Only numbers meet here; bytes follow for the blocks that stay.
    blocks = _rows_from(pieces.drop("_doc", "n", "first"), "piece long, gram long, block int, core long, all long", hashed)
    shared = blocks.groupBy("gram", "block", "core").agg(F.count(F.lit(1)).alias("n"), F.min("all").alias("low"), F.max("all").alias("high"))
    shared = shared.where("n > 1").select("gram", "block", "core", (F.col("low") == F.col("high")).alias("same"))
    wanted_blocks = (
        blocks.drop("all")
        .join(shared.hint("merge"), ["gram", "block", "core"])
        .groupBy("piece")
        .agg(F.collect_list(F.struct("block", "same")).alias("live"))
    )

    def placed(row):
        live = {x["block"]: x["same"] for x in row["live"]}
        for block, low, high, core, head, tail in _blocks(row["raw"], row["offset"], row["starts"], spec):
            if block in live:
                begin = row["first"] + row["offset"] + block * BLOCK
                same = live[block]
                yield row["_doc"], row["n"], begin, low, high, same, b"" if same else core, b"" if same else head + tail

    full = _rows_from(
        pieces.drop("gram").join(wanted_blocks.hint("merge"), "piece"),
        "_doc long, n long, begin int, low int, high int, same boolean, bytes binary, edge binary",
        placed,
    )
    live = stored(full.withColumn("piece", F.monotonically_increasing_id()), "live_blocks")
    equal = live.where("same and n = 1").select("_doc", (F.col("begin") + F.col("low")).alias("first"), (F.col("begin") + F.col("high")).alias("last"))
    unclear = live.where("not same")
    names = core_names(unclear.select("piece", F.col("bytes").alias("core")), spec)

    # Of the sixteen bytes around the core, so many stand before it as the place in the block leaves.
    start = F.explode(F.sequence("low", "high")).alias("i")
    around = F.expr(f"substring(edge, i - low + 1, {BLOCK})")
    rest = unclear.join(names.hint("merge"), "piece").select("_doc", "n", "begin", "name", "edge", "low", start)
    rest = rest.select("_doc", "n", (F.col("begin") + F.col("i")).alias("first"), "name", "i", around.alias("around"))
    rest = rest.withColumn("head", F.expr(f"substring(around, 1, {BLOCK} - i)")).withColumn("tail", F.expr(f"substring(around, {BLOCK} - i + 1)"))
    keys = ["i", "head", "name", "tail"]
    ordered = merged(rest.drop("around"), keys, ["_doc", "first"])
    found = with_equal_neighbour(ordered, keys).where("n = 1").select("_doc", "first", F.col("first").alias("last"))
    return whole.union(equal).union(found)


def kept_bytes(text: str | None, runs, spec: SuffixSpec) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left, length before, and the removed ranges in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not runs:
        return raw, len(raw), []
    step = np.zeros(len(raw) + 1, np.int64)
    first = np.fromiter((r["first"] for r in runs), np.int64, len(runs))
    last = np.fromiter((r["last"] for r in runs), np.int64, len(runs))
    np.add.at(step, first, 1)
    np.add.at(step, last + spec.length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    ranges = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), ranges


def suffix_dedup(docs: DataFrame, spec: SuffixSpec = SuffixSpec()) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (binary: what is left may begin or
    end inside a character), ``n_bytes``, ``removed`` (byte ranges) and
    ``n_shared``, the noted strings that stand elsewhere, too (zero: none).

    Null and empty texts have no bytes; texts shorter than ``length`` stay
    whole. Strings in repeated rows, or in rows that share an id, count as
    strings that start elsewhere. Columns of the same names are replaced, all
    others stay.
    """
    docs = without(docs, ["kept", "n_bytes", "removed", "n_shared"])
    plain = docs.select("doc_id", "text")
    held = noted_anchors(plain, spec)
    runs = repeated_starts(plain, held, spec).groupBy("_doc").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    found = runs.join(shared_strings(held), "_doc", "full").hint("merge")
    out = packed(docs).withColumn("_doc", F.xxhash64("doc_id", "text")).join(found, "_doc", "left").drop("_doc")
    out = out.withColumn("both", F.struct("text", "runs")).drop("runs")
    schema = "kept binary, n_bytes long, removed array<struct<start:long,end:long>>"
    done = with_text_columns(out, schema, lambda: lambda both: kept_bytes(both["text"], both["runs"], spec), text="both")
    return unpacked(done, docs.columns, "kept", "n_bytes", "removed", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def digest(left: DataFrame) -> DataFrame:
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_shared",
    )
