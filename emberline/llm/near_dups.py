"""MinHash near-dedup with b-bit signatures.

Each text gets 128 minima over its word shingles. Bands of full minima give
the candidates; of each minimum only the low four bits are kept, packed sixteen
to a long, and the similarity of a candidate pair is estimated from the number
of equal fields, corrected for fields that are equal by chance. What the
estimate can't rule out is compared on full shingle sets.

Copies are one node from the start. Buckets are not expanded into pairs: first
every member is compared with one pivot, on packed signatures and then, if the
estimate allows it, on full sets. Large buckets whose members are then still in
different groups get further pivots. What is open after that is mostly not
similar, but shares passages. There, members outside the bucket's largest group
are held against all others inside the join, on packed signatures and then on
parities: the shingles of a set are counted in cells, modulo two, and the cells
in which two sets differ are never more than the shingles in which they do. So
the test loses no pair, and those that are similar but below the threshold
mostly don't become rows. The full sets of the others are compared block by
block, so a text is sent once for many of its pairs. Pairs inside one group are
never made, and no bucket is cut.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberline.llm.arrow import packed as with_rest
from emberline.llm.arrow import ship_package, unpacked, with_text_columns, without
from emberline.llm.graph import connected
from emberline.llm.words import STEP, mixed, shingles
from emberline.sources.writers import stored

BITS = 4
PER_LONG = 64 // BITS
_LOW = 0x1111111111111111


@dataclass(frozen=True)
class NearSpec:
    """A pair at the threshold is in no common band once in 200,000 cases;
    ``slack`` is five standard errors of the estimate. ``pivots``: rounds of
    pivots; those after the first only while a bucket of more than ``small``
    members is open. ``block``: members whose texts are compared in one row."""

    words: int = 5
    similar: tuple[int, int] = (75, 100)
    bands: int = 32
    rows: int = 4
    slack: float = 0.2
    pivots: int = 2
    small: int = 32
    block: int = 64

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def _minima(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n keyed hashes, in blocks that stay in the cache."""
    keys = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP))
    factors = mixed(keys) | np.uint64(1)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 512):
        part = values[start : start + 512]
        np.minimum(out, ((part[None, :] ^ keys[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each cell holds an odd number of shingles, 64 cells to a long;
    there are four to eight cells a shingle, and a power of two of them."""
    cells = 1 << max(6, (4 * len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _key(found: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        halves = [found.sum(dtype=np.uint64), mixed(found).sum(dtype=np.uint64)]
    return np.array([*halves, len(found)], np.uint64).tobytes()


def signature(text: str | None, spec: NearSpec) -> tuple:
    """(number of shingles, key of the set, packed low bits, band keys)."""
    found = shingles(text, spec.words)
    if not len(found):
        return 0, None, None, None
    minima = _minima(found, spec.minima)
    low = (mixed(minima) & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
    packed = (low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    bands = np.arange(1, spec.bands + 1, dtype=np.uint64)
    for row in minima.reshape(spec.bands, spec.rows).T:
        bands = mixed(bands * np.uint64(STEP) + row)
    return len(found), _key(found), packed.view(np.int64).tolist(), bands.view(np.int64).tolist()


def estimate(left, right, spec: NearSpec):
    """The similarity of two packed signatures: equal fields are counted by
    bits, then what is equal by chance is taken off."""

    def equal(i):
        x = left[i].bitwiseXOR(right[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.lit(PER_LONG) - F.bit_count(x.bitwiseAND(F.lit(_LOW)))

    share = reduce(lambda a, b: a + b, [equal(i) for i in range(spec.minima // PER_LONG)]) / spec.minima
    chance = 1 / (1 << BITS)
    return (share - chance) / (1 - chance)


def _close(x: str, y: str, spec: NearSpec):
    low, high = spec.similar
    return estimate(F.col(x), F.col(y), spec) >= low / high - spec.slack


def _halved(odd):
    """Parities of half as many cells."""
    half = F.floor(F.size(odd) / 2).cast("int")
    return F.zip_with(F.slice(odd, F.lit(1), half), F.slice(odd, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def _within(nx: str, x: str, hx: str, ny: str, y: str, hy: str, spec: NearSpec):
    """False only if two sets can't be similar, by their numbers of shingles n,
    their parities and those of half as many cells h. Sets whose cells differ
    by more than one halving are told by the numbers alone."""
    low, high = spec.similar
    x, hx, y, hy, nx, ny = (F.col(c) for c in (x, hx, y, hy, nx, ny))

    def differing(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, more: n + more)

    cells = F.when(F.size(x) == F.size(y), differing(x, y)).when(F.size(x) == 2 * F.size(y), differing(hx, y)).when(2 * F.size(x) == F.size(y), differing(x, hy)).otherwise(0)
    sizes = high * F.least(nx, ny) >= low * F.greatest(nx, ny)
    return sizes & ((high + low) * cells <= (high - low) * (nx + ny))


def _confirmed(pairs: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs (a, b) that are similar on full sets."""
    ship_package(pairs.sparkSession)
    low, high = spec.similar
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"
    )

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def of(node, text):
            # Pairs of one pivot mostly come together.
            if node not in held:
                if len(held) >= 8:
                    held.clear()
                held[node] = shingles(text, spec.words)
            return held[node]

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                a, b = batch.column("a"), batch.column("b")
                keep = []
                for i in range(batch.num_rows):
                    text = batch.column("ta")[i].as_py()
                    x = of((a[i].as_py(), text), text)
                    y = shingles(batch.column("tb")[i].as_py(), spec.words)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and high * both >= low * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = both.select("a", "b", "ta", "tb")
    return both.mapInArrow(run, both.select("a", "b").schema)


def _confirmed_in_blocks(pairs: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """The same for pairs that are many for their members. Members of a group
    that the pairs connect are dealt to blocks of a bounded number; a row holds
    the pairs between two blocks and the texts of both, each once."""
    ship_package(pairs.sparkSession)
    low, high = spec.similar
    groups = connected(pairs)
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / spec.block).cast("long").alias("blocks"))
    placed = groups.join(sizes, "component").select("node", F.col("component").alias("group"), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    placed = stored(placed, "placed")
    ends = pairs.join(placed.toDF("a", "group", "x"), "a").join(placed.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    # The block of the smaller number comes first, so two blocks make one row.
    swap = F.col("x") > F.col("y")
    ends = ends.select("group", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(swap, F.struct("b", "a")).otherwise(F.struct(F.col("a").alias("b"), F.col("b").alias("a"))).alias("p"))
    ends = ends.groupBy("group", "x", "y").agg(F.collect_list(F.struct(F.col("p.b").alias("s"), F.col("p.a").alias("t"))).alias("pairs"))
    member = F.struct("node", "text")
    blocks = stored(placed.join(texts, "node").groupBy("group", "block").agg(F.collect_list(member).alias("members")), "blocks")
    left = blocks.select("group", F.col("block").alias("x"), F.col("members").alias("left"))
    right = blocks.select("group", F.col("block").alias("y"), F.col("members").alias("right"))
    rows = ends.join(left, ["group", "x"]).withColumn("other", F.when(F.col("x") < F.col("y"), F.col("y")))
    rows = rows.join(right.withColumnsRenamed({"group": "same", "y": "at"}), (F.col("group") == F.col("same")) & (F.col("other") == F.col("at")), "left")

    def sets(members) -> dict:
        out: dict = {}
        for m in members or ():
            out.setdefault(m["node"], []).append(shingles(m["text"], spec.words))
        return out

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and high * both >= low * (len(x) + len(y) - both)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("pairs", "left", "right")}
                one = sets(row["left"])
                two = sets(row["right"]) if row["right"] else one
                found = [(p["s"], p["t"]) for p in row["pairs"] if any(similar(u, v) for u in one.get(p["s"], ()) for v in two.get(p["t"], ()))]
                arrays = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    kinds = [to_arrow_type(f.dataType) for f in pairs.select("a", "b").schema.fields]
    return rows.select("pairs", "left", "right").mapInArrow(run, pairs.select("a", "b").schema)


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, packed, component, size) of the buckets that hold several groups."""
    grouped = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    return grouped.join(several.where("low < high").select("band", "size"), "band").select("band", "node", "packed", "component", "size")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of different nodes, the smaller first, once each."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _pivot_pairs(open_: DataFrame, turn: int, spec: NearSpec) -> DataFrame:
    """Each member with its bucket's pivot, if they may be similar and aren't in
    one group. The first pivot is the smallest node, which a group's buckets
    share; then each bucket draws its own by hash, so that a member meets many."""
    drawn = F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "band", "node")
    order = F.struct(drawn.alias("drawn"), "node", "component", "packed")
    pivots = open_.groupBy("band").agg(F.min(order).alias("p"))
    pivots = pivots.select("band", F.col("p.node").alias("x"), F.col("p.component").alias("group"), F.col("p.packed").alias("px"))
    pairs = open_.withColumnRenamed("node", "y").join(pivots, "band").where(F.col("component") != F.col("group"))
    return _ordered(pairs.where(_close("px", "packed", spec)))


def _sets(open_: DataFrame, classes: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """(node, packed, n_shingles, odd) of the members of open buckets; an id may
    have several. Most texts are in none, so parities are made of these only."""

    def of(text):
        found = shingles(text, spec.words)
        return (_key(found), len(found), parities(found).tolist()) if len(found) else (None, 0, None)

    members = texts.join(open_.select("node").distinct(), "node", "left_semi")
    found = with_text_columns(members, "key binary, n_shingles long, odd array<long>", lambda: of)
    return found.drop("text").distinct().join(classes.select("node", "key", "packed"), ["node", "key"]).drop("key")


def _other_pairs(open_: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """Members outside their bucket's largest group with the members of other
    groups that they may be similar to."""
    sizes = open_.groupBy("band", "component").count()
    largest = sizes.groupBy("band").agg(F.max(F.struct("count", "component")).alias("m")).select("band", F.col("m.component").alias("largest"))
    placed = open_.join(sets.withColumn("half", _halved("odd")), ["node", "packed"]).join(largest, "band").withColumn("inside", F.col("component") == F.col("largest"))
    placed = stored(placed.select("band", "node", "component", "packed", "inside", "n_shingles", "odd", "half"), "open_sets")
    x = placed.where("not inside").select(F.col("band").alias("same"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("packed").alias("px"), F.col("n_shingles").alias("nx"), F.col("odd").alias("ox"), F.col("half").alias("hx"))
    y = placed.withColumnRenamed("node", "y")
    # Of two members outside, the pair is looked at once.
    once = F.col("inside") | (F.col("x") < F.col("y"))
    other = (F.col("same") == F.col("band")) & (F.col("cx") != F.col("component")) & once
    return _ordered(x.join(y, other & _close("px", "packed", spec) & _within("nx", "ox", "hx", "n_shingles", "odd", "half", spec)))


def near_duplicates(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """The rows of ``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Texts without words and null texts are linked with nothing: they are their
    own component and kept. Texts of fewer words than a shingle has are linked
    if their words are equal. Equal sets are linked, however many. Rows that
    share an id count as one document: each has the component that any of
    them is linked into. Rows with a null id are linked with nothing. Ids may
    be of any type that has an order. Columns of the three names are replaced,
    all others stay.
    """
    docs = without(docs, ["n_shingles", "component_id", "kept"])
    signed = with_text_columns(
        docs.select("doc_id", "text"),
        "n_shingles long, key binary, packed array<long>, bands array<long>",
        lambda: lambda text: signature(text, spec),
    ).select("doc_id", F.xxhash64("text").alias("text_key"), "n_shingles", "key", "packed", "bands")
    signed = stored(signed, "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(some.groupBy("key", "packed", "bands").agg(F.min("doc_id").alias("node")), "shingle_sets")
    nodes = classes.select("node", "packed", "bands")
    banded = nodes.select("node", F.explode("bands").alias("band")).distinct()
    several = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = banded.join(several.select("band"), "band")
    shared = stored(shared.join(nodes.select("node", "packed"), "node").select("band", "node", "packed"), "shared_bands")
    # Only texts that share a band with another are moved and compared.
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("text is not null")
    texts = stored(texts.join(shared.select("node").distinct(), "node", "left_semi"), "candidates")

    tried = links = shared.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    labels = shared.select("node", F.col("node").alias("component")).where("false")
    turn, last = 0, False
    while not last:
        open_ = stored(_open(shared, labels), "open_buckets")
        largest = open_.agg(F.max("size")).head()[0]
        if largest is None:
            break
        last = turn >= spec.pivots or (turn > 0 and largest <= spec.small)
        pairs = _other_pairs(open_, _sets(open_, classes, texts, spec), spec) if last else _pivot_pairs(open_, turn, spec)
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        tried = tried.union(pairs) if turn else pairs
        confirmed = _confirmed_in_blocks if last else _confirmed
        found = stored(confirmed(pairs, texts, spec), "links")
        links = links.union(found) if turn else found
        if not last:
            labels = connected(links)
        turn += 1

    # An id may stand for rows of several sets, and then connects them.
    placed = some.select("doc_id", "key").join(classes.select("key", "node"), "key").select("doc_id", "node").distinct()
    placed = stored(placed, "classes")
    ids = placed.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    bridges = placed.join(ids.where("node < other").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    whole = connected(links.union(bridges))
    groups = ids.join(whole, "node", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "node").alias("group"))
    sizes = signed.select(F.col("doc_id").alias("of"), "text_key", "n_shingles").distinct()
    rows = with_rest(docs).withColumn("row", F.xxhash64("text"))
    out = rows.join(sizes, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("text_key")))
    out = out.join(groups, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("group", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return unpacked(out, docs.columns, "n_shingles", component.alias("component_id"), kept.alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")
