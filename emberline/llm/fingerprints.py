"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits are linked if at most two bits differ. They are cut
into two segments, so one of the two differs by at most one bit. A pair either
agrees in one segment, or differs by one bit in each; so a fingerprint is
indexed under both segments, and under the first with each single bit left out
(a variant), on which only fingerprints that differ in that bit are joined.
Equal keys meet in a join, and the bits that differ are counted on whole
fingerprints.

Equal fingerprints are one node from the start. Keys that many fingerprints
share are refined before they are joined: the bits that the key leaves open are
cut in two and indexed the same way, until a key holds few or the open bits
are so few that it can't hold many. So no pairs are made within large groups,
and none are lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.arrow import fresh, with_text_columns, without
from emberline.llm.graph import connected
from emberline.llm.words import code_points, lower_ascii, word_bounds
from emberline.sources.writers import stored

BITS = 64
#: The seed of the shingles' hashes; a fixed value.
SEED = 42
#: Hashes whose bits are unfolded at one time.
AT_ONCE = 1 << 14


@dataclass(frozen=True)
class SimSpec:
    """``few``: fingerprints of a key that are joined without refining it."""

    words: int = 3
    few: int = 32


def fingerprint(text: str | None, spec: SimSpec = SimSpec()) -> int:
    """The fingerprint as a signed long; zero without words."""
    if not text:
        return 0
    points = lower_ascii(code_points(text))
    starts, ends = word_bounds(points)
    if not len(starts):
        return 0
    lowered = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    words = [lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    n = min(spec.words, len(words))
    size = len(words) - n + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, size, AT_ONCE):
        runs = zip(*[words[start + k : min(size, start + AT_ONCE) + k] for k in range(n)])
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(r).encode("utf-8", "surrogatepass"), SEED) for r in runs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > size).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """``docs`` with ``bits``, the fingerprint of each text as a long."""
    return with_text_columns(docs, "bits long", lambda: lambda text: (fingerprint(text, spec),))


def _cut(low: Column, width: int, at: int) -> Column:
    """The start of the first or second half of the open bits."""
    return low + (0 if at == 0 else width // 2)


def _part(bits: Column, low: Column, width: int) -> Column:
    """``width`` bits from ``low`` on, as a long."""
    return F.call_function("shiftrightunsigned", bits, low.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _indexed(rows: DataFrame, width: int) -> DataFrame:
    """(key, side, left, low, bits, node): the keys of each row of (key, side,
    left, low, bits, node), ``width`` of whose bits are open from ``low`` on,
    of which at most ``left`` may differ. Half of them stay open.

    ``side`` is the value of the bit that was left out, and null if none was:
    then at most two bits may differ, else one.
    """
    half = width // 2
    bits, low = F.col("bits"), F.col("low")
    first, second = (_part(bits, _cut(low, width, at), half) for at in (0, 1))

    def entry(kind, part: Column, side, left: int | Column, open_from: Column) -> Column:
        return F.struct(
            F.xxhash64("key", F.lit(width), kind, part).alias("key"),
            side.cast("byte").alias("side"),
            (F.lit(left) if isinstance(left, int) else left).cast("byte").alias("left"),
            open_from.cast("byte").alias("low"),
        )

    same = [
        entry(F.lit(-1), first, F.col("side"), F.col("left"), _cut(low, width, 1)),
        entry(F.lit(-2), second, F.col("side"), F.col("left"), _cut(low, width, 0)),
    ]
    each = F.transform(
        F.sequence(F.lit(0), F.lit(half - 1)),
        lambda i: entry(
            i,
            first.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
            F.call_function("shiftrightunsigned", first, i).bitwiseAND(F.lit(1)),
            1,
            _cut(low, width, 1),
        ),
    )
    keys = F.when(F.col("left") == 2, F.concat(F.array(*same), each)).otherwise(F.array(*same))
    return rows.select(F.explode(keys).alias("k"), "bits", "node").select("k.*", "bits", "node")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key another fingerprint has that may be linked, with
    ``size``, the fingerprints of the key. Where a bit was left out, both of
    its values have to occur.

    Neither side is broadcast, however small it is taken to be: Spark sizes
    the keys that a fingerprint is unfolded into as the fingerprint alone."""
    sizes = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("side").alias("s0"), F.max("side").alias("s1"), F.bool_and(F.col("side").isNotNull()).alias("varied")
    )
    sizes = sizes.where("size > 1 and (not varied or s0 < s1)").select("key", "size")
    return rows.join(sizes.hint("merge"), "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """The links (a, b) of nodes that share a key."""
    x = rows.select("key", F.col("side").alias("s"), F.col("bits").alias("p"), F.col("node").alias("a"))
    y = rows.select(F.col("key").alias("same"), F.col("side").alias("t"), F.col("bits").alias("q"), F.col("node").alias("b"))
    ordered = F.when(F.col("s").isNull(), F.col("p") < F.col("q")).otherwise(F.col("s") < F.col("t"))
    close = F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 2
    return x.join(y.hint("merge"), (F.col("key") == F.col("same")) & ordered & close).select("a", "b")


def links(nodes: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """Links (a, b) between the nodes (node, bits) of different fingerprints of
    which at most two bits differ."""
    rows = nodes.select(
        F.lit(0).cast("long").alias("key"),
        F.lit(None).cast("byte").alias("side"),
        F.lit(2).cast("byte").alias("left"),
        F.lit(0).cast("byte").alias("low"),
        "bits",
        "node",
    )
    found, width = [], BITS
    while True:
        rows = stored(_shared(_indexed(rows, width)), "fingerprint_keys")
        width //= 2
        # With so few bits open a key can't hold many different fingerprints.
        if 2 << width <= spec.few:
            found.append(_pairs(rows))
            break
        found.append(_pairs(rows.where(F.col("size") <= spec.few)))
        rows = rows.where(F.col("size") > spec.few).drop("size")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def near_fingerprints(rows: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """``rows`` (doc_id, bits, any others) with ``component_id``, the smallest
    doc_id that can be reached over fingerprints that differ in two bits or
    fewer.

    Rows of equal fingerprints are linked, those without words too (zero).
    Rows that share an id are linked by their own fingerprints only, unless a
    third connects them; each has the component of its fingerprint. A null
    doc_id links nothing, and its component_id is null; so is it for null
    bits. Columns of that name are replaced, all others stay; an empty table
    gives none.
    """
    rows = without(rows, ["component_id"])
    nodes = rows.where("doc_id is not null and bits is not null").groupBy("bits").agg(F.min("doc_id").alias("doc"))
    nodes = stored(nodes.select(F.col("bits").alias("node"), "bits", "doc"), "fingerprints")
    # Over fingerprints, as one id may stand for rows of several texts.
    groups = connected(links(nodes.select("node", "bits"), spec))
    placed = nodes.join(groups.hint("merge"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = placed.groupBy("group").agg(F.min("doc").alias("least"))
    placed = placed.join(least.hint("merge"), "group").select(F.col("bits").alias("_bits"), "least")
    of, found = fresh(rows, "_of"), fresh(rows, "_least")
    out = rows.join(placed.toDF(of, found).hint("merge"), F.col("bits") == F.col(of), "left")
    return out.select(*rows.columns, F.when(F.col("doc_id").isNotNull(), F.col(found)).alias("component_id"))


def sim_duplicates(docs: DataFrame, spec: SimSpec = SimSpec()) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of
    each row of ``docs``; null and empty texts have fingerprint zero. Other
    columns are ignored."""
    signed = stored(fingerprints(docs.select("doc_id", "text"), spec).select("doc_id", "bits"), "signed")
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return near_fingerprints(signed, spec).select("doc_id", digits.alias("fingerprint"), "component_id")
