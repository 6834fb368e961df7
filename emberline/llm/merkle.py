"""A Merkle tree over the rows of a dataset, and a proof for every row.

Leaves are digests of rows. Those of one group ascend by id, and every eight
consecutive nodes become their parent until one is left, the group's subroot;
subroots, ordered by group, grow into the root the same way.

Proofs are found by pointer jumping. Every inner node holds the sibling
segments from itself to an ancestor, at first its parent. A self-join doubles
the distance: a node takes over its ancestor's ancestor and appends its
segments. After the logarithm of the depth all reach the root, and each leaf
jumps once over its parent's whole distance. So the long segments are moved for
an eighth of the nodes only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.sources.writers import stored


@dataclass(frozen=True)
class TreeSpec:
    """``fields``: the columns of a leaf in order; ``run``: children of a node."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    run: int = 8


#: The group of the tree over the subroots; those of leaves begin with - or =.
TOP = ""
PATH = "array<struct<left:binary,right:binary>>"


def leaf_digest(values: list[Column]) -> Column:
    """The SHA-256 of the values, each with its length in UTF-8 bytes, as hexadecimal digits."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """The bytes of an array of digests in a row."""
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the rank from 0 within the group, and ``n``, the
    group's rows. Each range of the sorted rows counts its own, and the ranges'
    numbers are added up; so a group may hold most rows."""
    placed = rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id())
    placed = stored(placed, "merkle_ranges")
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n_part"))
    whole = Window.partitionBy(group)
    before = F.sum("n_part").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n_part").over(whole).alias("n"))
    local = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    out = placed.withColumn("local", local).join(counts, [group, "part"])
    return out.select(*rows.columns, (F.col("before") + F.col("local")).alias("idx"), "n")


def _runs(nodes: DataFrame, level: int, spec: TreeSpec, payload: tuple[str, ...] = ()) -> DataFrame:
    """(grp, level, up, kids, digest, n, n_up): every ``run`` consecutive nodes
    of a group. A group of one node keeps it."""
    runs = nodes.groupBy("grp", F.expr(f"idx div {spec.run}").alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest", *payload))).alias("kids"), F.max("n").alias("n")
    )
    text = F.array_join(F.transform("kids", lambda k: digits(k["digest"])), "")
    one = F.col("kids")[0]["digest"]
    return stored(
        runs.select(
            "grp",
            F.lit(level).alias("level"),
            "up",
            "kids",
            F.when(F.col("n") > 1, F.unhex(F.sha2(text, 256))).otherwise(one).alias("digest"),
            "n",
            F.expr(f"(n + {spec.run - 1}) div {spec.run}").alias("n_up"),
        ),
        "merkle_level",
    )


def _grown(leaves: DataFrame, spec: TreeSpec, payload: tuple[str, ...] = ()) -> list[DataFrame]:
    """The runs of all levels, from the leaves up; at least one."""
    levels = [_runs(leaves, 0, spec, payload)]
    most = levels[0].agg(F.max("n_up")).head()[0] or 0
    while most > 1:
        # Groups that have come down to one node need no further level.
        nodes = levels[-1].where("n_up > 1").select("grp", F.col("up").alias("idx"), "digest", F.col("n_up").alias("n"))
        levels.append(_runs(nodes, len(levels), spec))
        most = -(-most // spec.run)
    return levels


def _ends(levels: list[DataFrame]) -> DataFrame:
    """(grp, level, digest) of the node each group comes down to."""
    each = [runs.where("n_up = 1").select("grp", F.when(F.col("n") > 1, F.col("level") + 1).otherwise(F.col("level")).alias("level"), "digest") for runs in levels]
    return reduce(DataFrame.union, each)


def _segment(kids: Column, at: Column, run: int) -> Column:
    """The digests left and right of the child ``at`` (from 0), as bytes."""
    plain = F.transform(kids, lambda k: k["digest"])
    return F.struct(_joined(F.slice(plain, F.lit(1), at)).alias("left"), _joined(F.slice(plain, at + 2, F.lit(run))).alias("right"))


def _children(runs: DataFrame, spec: TreeSpec) -> DataFrame:
    """The nodes below each run, with their way to the parent."""
    rows = runs.where("n > 1").select("grp", "level", "up", "kids", F.posexplode("kids").alias("at", "kid"))
    return rows.select(
        "grp",
        "level",
        F.col("kid.idx").alias("idx"),
        F.array(_segment(F.col("kids"), F.col("at"), spec.run)).cast(PATH).alias("path"),
        F.col("grp").alias("to_grp"),
        (F.col("level") + 1).alias("to_level"),
        F.col("up").alias("to_idx"),
        F.lit(None).cast("binary").alias("subroot"),
    )


def _doubled(nodes: DataFrame) -> DataFrame:
    """Every node's way and its ancestor's, one after the other."""
    up = nodes.select(
        F.col("grp").alias("to_grp"),
        F.col("level").alias("to_level"),
        F.col("idx").alias("to_idx"),
        F.col("path").alias("further"),
        F.struct("to_grp", "to_level", "to_idx").alias("end"),
        F.col("subroot").alias("later"),
    )
    return nodes.join(up, ["to_grp", "to_level", "to_idx"]).select(
        "grp",
        "level",
        "idx",
        F.concat("path", "further").alias("path"),
        F.col("end.to_grp").alias("to_grp"),
        F.col("end.to_level").alias("to_level"),
        F.col("end.to_idx").alias("to_idx"),
        F.coalesce("subroot", "later").alias("subroot"),
    )


def proofs(docs: DataFrame, shown: Column | None = None, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """doc_id, leaf, subroot and root as hexadecimal digits, ``path`` and
    ``shown`` for each row of ``docs``.

    ``path`` has for each level the digests left and right of the row's node,
    from the leaf up; a level at which a group has one node left adds none.
    ``shown`` is the digest of the row with the text ``shown``, which is what a
    holder of the row would hash; null if none is given or it is null.

    Null ids come first and null groups before all others. Rows that share an
    id are ordered by their digests; repeated rows are leaves of their own.
    Null fields are hashed as such, so they differ from empty ones. An empty
    table has no root and gives no rows. Columns that aren't fields are ignored.
    """
    fields = [F.col(f) for f in spec.fields]
    other = F.lit(None).cast("string") if shown is None else leaf_digest([shown if f == "text" else F.col(f) for f in spec.fields])
    other = other if shown is None else F.when(shown.isNotNull(), other)
    group = F.coalesce(F.concat(F.lit("="), F.col(spec.group).cast("string")), F.lit("-"))
    rows = docs.select(
        F.col(spec.order).alias("id"),
        group.alias("grp"),
        F.unhex(leaf_digest(fields)).alias("digest"),
        F.unhex(other).alias("shown"),
        # Spreads repeated rows over ranges; which of them comes first makes no difference.
        F.monotonically_increasing_id().alias("salt"),
    )
    leaves = ranked(stored(rows, "merkle_rows"), "grp", ["id", "digest", "salt"])
    levels = _grown(leaves, spec, ("id", "shown"))
    tops = ranked(_ends(levels).withColumn("top", F.lit(TOP)), "top", ["grp"])
    tops = stored(tops, "merkle_subroots")
    above = _grown(tops.select(F.col("top").alias("grp"), "idx", "digest", "n"), spec)
    root = _ends(above).head()
    top_level = root["level"] if root else 0

    # A subroot goes on as a leaf of the upper tree; the root leads to itself.
    nothing = F.array().cast(PATH)
    bridges = tops.select(
        "grp", "level", F.lit(0).cast("long").alias("idx"), nothing.alias("path"), F.lit(TOP).alias("to_grp"), F.lit(0).alias("to_level"), F.col("idx").alias("to_idx"), F.col("digest").alias("subroot")
    )
    end = _ends(above).select(
        F.lit(TOP).alias("grp"),
        "level",
        F.lit(0).cast("long").alias("idx"),
        nothing.alias("path"),
        F.lit(TOP).alias("to_grp"),
        F.col("level").alias("to_level"),
        F.lit(0).cast("long").alias("to_idx"),
        F.lit(None).cast("binary").alias("subroot"),
    )
    inner = [_children(runs, spec) for runs in [*levels[1:], *above]]
    nodes = stored(reduce(DataFrame.union, [*inner, bridges, end]), "merkle_ways")
    reach, depth = 1, len(levels) + 1 + top_level
    while reach < depth:
        nodes, reach = stored(_doubled(nodes), "merkle_ways"), reach * 2

    parents = nodes.select("grp", F.col("level").alias("to_level"), F.col("idx").alias("up"), F.col("path").alias("further"), "subroot")
    runs = levels[0].select("grp", "up", "kids", "n", F.when(F.col("n") > 1, 1).otherwise(0).alias("to_level"))
    found = runs.join(parents, ["grp", "to_level", "up"]).select("kids", "n", "further", "subroot", F.posexplode("kids").alias("at", "kid"))
    first = F.when(F.col("n") > 1, F.array(_segment(F.col("kids"), F.col("at"), spec.run)).cast(PATH)).otherwise(nothing)
    return found.select(
        F.col("kid.id").alias("doc_id"),
        digits(F.col("kid.digest")).alias("leaf"),
        digits(F.col("subroot")).alias("subroot"),
        digits(F.lit(bytes(root["digest"]) if root else None).cast("binary")).alias("root"),
        F.concat(first, "further").alias("path"),
        digits(F.col("kid.shown")).alias("shown"),
    )


def path_text(path: Column) -> Column:
    """All siblings of a path, from the leaf up and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(digits(s["left"]), digits(s["right"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(digits(s["left"]), h, digits(s["right"])), 256))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(text: Column, doc_id: Column) -> Column:
    """The text in small letters where 3 divides the checksum of the id, else null."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, CAPITALS, SMALL))


def digest(found: DataFrame) -> DataFrame:
    """A row whose text is shown (also if it equals the original) is folded from it."""
    root = folded(F.coalesce("shown", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(path_text(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
