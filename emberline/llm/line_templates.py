"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its first
tokens. Tokens with a digit are variable fields from the start. A leaf has as many
patterns as it needs: lines that are equal but for their rarest tokens, or in a band
of tokens, meet, and those that agree with the most common of them in most
positions belong to its template, the other positions being variable fields. Lines
that agree with none are templates of their own. A template found in many documents
is dropped from all of them but the first.

Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.arrow import packed, unpacked, without
from emberline.sources.writers import stored


@dataclass(frozen=True)
class LineSpec:
    """``depth``: first tokens that lead to a leaf; ``agree``: least share of
    equal positions, as a fraction; ``documents``: from how many documents on
    a template recurs, ``long_documents`` if a line of it has ``long_words``
    tokens and more without a digit."""

    depth: int = 3
    agree: tuple[int, int] = (4, 5)
    documents: int = 20
    long_words: int = 50
    long_documents: int = 2

    def enough(self) -> Column:
        """The documents that a group with the column ``long`` takes."""
        return F.when(F.max("long"), min(self.long_documents, self.documents)).otherwise(self.documents)


def _split(text: Column) -> Column:
    """The lines of a text, all blanks in them being spaces."""
    plain, found = text, F.lit(False)
    for blank in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
        found = found | text.contains(blank)
    return F.split(F.when(found, plain).otherwise(text), "\n")


def _spaced(line: Column) -> Column:
    """The tokens, one space apart. Most lines are so already; only the others
    meet a pattern."""
    loose = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(loose, F.trim(F.regexp_replace(line, " +", " "))).otherwise(line)


def _masked(tokens: Column) -> Column:
    """``<*>`` for the tokens that have a digit."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(tokens)


def _parts(text: Column, mark: str) -> Column:
    """One more than there are marks of one byte. Bytes are known; characters
    would be counted."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark))) + 1


def _tokens(line: Column) -> Column:
    return _parts(line, " ")


def _long(line: Column, n: Column, spec: LineSpec) -> Column:
    """Of n tokens, as many as masking leaves."""
    plain = F.array_remove(F.split(line, " "), "<*>")
    return (n >= spec.long_words) & (~line.contains("<*>") | (F.size(plain) >= spec.long_words))


def _row(docs: DataFrame) -> Column:
    """Tells apart rows that share an id; compared together with the id."""
    return F.xxhash64("doc_id", "text")


def _leaf(spec: LineSpec) -> Column:
    """Of n tokens of a line, one space apart: their number and the first ones."""
    return F.xxhash64("n", _masked(F.substring_index("line", " ", spec.depth)))


def _agreeing(a: Column, b: Column, spec: LineSpec) -> Column:
    up, down = spec.agree
    equal = F.size(F.filter(F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: x == y), lambda same: same))
    return down * equal >= up * F.size(F.split(a, " "))


def _buckets(variants: DataFrame, spec: LineSpec) -> DataFrame:
    """(leaf, key, documents, long, bucket, masked) of variants that may have variable
    fields. Lines of one template meet in a bucket: ``masked``, where their
    rarest tokens are left out, one more in each; or by one of the bands of
    neighbouring tokens, of which there is one more than variable fields."""
    up, down = spec.agree
    zero = F.lit(0).cast("long")

    def folded(hashes: Column) -> Column:
        return F.aggregate(hashes, zero, lambda a, h: a.bitwiseXOR(h))

    tokens = variants.withColumn("hashes", F.transform(F.split("line", " "), lambda t, i: F.xxhash64(i, t)))
    tokens = tokens.withColumn("n", F.size("hashes")).withColumn("fields", F.expr(f"n * {down - up} div {down}").cast("int"))
    tokens = tokens.where(f"fields > 0 and n > {spec.depth}")
    each = tokens.select("leaf", "key", "documents", F.explode(F.expr(f"slice(hashes, {spec.depth + 1}, n)")).alias("hash"))
    seen = each.groupBy("leaf", "hash").agg(F.sum("documents").alias("seen"))
    rare = each.join(seen, ["leaf", "hash"]).groupBy("leaf", "key").agg(F.sort_array(F.collect_list(F.struct("seen", "hash"))).alias("rare"))
    masks = F.aggregate(
        F.slice("rare", 1, F.col("fields")),
        F.array(folded(F.col("hashes"))),
        lambda found, r: F.concat(found, F.array(F.element_at(found, -1).bitwiseXOR(r["hash"]))),
    )
    free = f"(n - {spec.depth})"
    bounds = F.transform(F.sequence(F.lit(0), F.col("fields")), lambda b: F.struct(b.alias("b")))
    bands = F.transform(
        bounds,
        lambda x: F.xxhash64(
            x["b"],
            folded(
                F.slice(
                    "hashes",
                    F.floor(x["b"] * F.expr(free) / (F.col("fields") + 1)).cast("int") + spec.depth + 1,
                    (F.floor((x["b"] + 1) * F.expr(free) / (F.col("fields") + 1)) - F.floor(x["b"] * F.expr(free) / (F.col("fields") + 1))).cast("int"),
                )
            ),
        ),
    )
    kinds = F.concat(
        F.transform(F.slice(masks, 2, F.col("fields")), lambda m: F.struct(m.alias("bucket"), F.lit(True).alias("masked"))),
        F.transform(bands, lambda m: F.struct(m.alias("bucket"), F.lit(False).alias("masked"))),
    )
    return tokens.join(rare, ["leaf", "key"]).select("leaf", "key", "documents", "long", F.inline(kinds))


def _families(variants: DataFrame, held: DataFrame, spec: LineSpec) -> DataFrame:
    """(leaf, key, family) of the variants that belong to a template.

    Each bucket has a pivot: the line whose masked tokens most documents share.
    Lines that agree with a pivot of theirs join the one that gathers the most
    documents. Rounds go on over the lines that are left, until no template
    reaches the documents that it takes. Documents are counted in sketches that
    are exact well beyond that number.
    """
    exact = max(8, spec.documents.bit_length() + 2)
    union = F.theta_sketch_estimate(F.theta_union_agg("docs", exact))

    def reaching(rows: DataFrame, group: str) -> DataFrame:
        counted = rows.join(docs, ["key", "leaf"]).groupBy("leaf", group).agg(union.alias("n"), spec.enough().alias("enough"))
        return counted.where("n >= enough").drop("enough")

    left, found, docs = variants, None, None
    while True:
        buckets = stored(_buckets(left, spec), "line_buckets")
        full = buckets.groupBy("bucket", "leaf").agg(
            F.sum("documents").alias("n"),
            F.count(F.lit(1)).alias("size"),
            spec.enough().alias("enough"),
            F.bit_xor(F.xxhash64("key")).alias("members"),
            F.max("masked").alias("masked"),
        )
        # Long lines that differ in a token meet in most of their buckets. Buckets of
        # the same lines have the same pivot, so one of them stands for all.
        full = full.where("n >= enough and size > 1").groupBy("leaf", "n", "size", "members")
        full = full.agg(F.max(F.struct("masked", "bucket")).alias("one")).select("leaf", "one.bucket")
        # Read three times; as a table it is made once and the driver's plans stay short.
        buckets = stored(buckets.drop("long").join(full.hint("shuffle_hash"), ["bucket", "leaf"]), "line_crowded_buckets")
        if docs is None:
            some = buckets.select("leaf", "key").distinct()
            docs = held.join(some, ["key", "leaf"]).groupBy("leaf", "key").agg(F.theta_sketch_agg("_doc", exact).alias("docs"), F.max("long").alias("long"))
            docs = stored(docs, "line_documents")
        buckets = stored(buckets.join(reaching(buckets, "bucket"), ["bucket", "leaf"]), "line_full_buckets")
        score = buckets.groupBy("leaf", "key").agg(F.max(F.when(F.col("masked"), F.col("n")).otherwise(F.col("documents"))).alias("score"))
        pivots = buckets.join(score, ["key", "leaf"]).groupBy("leaf", "bucket").agg(F.min(F.struct(-F.col("score"), -F.col("documents"), "key")).alias("p"))
        pairs = buckets.join(pivots.select("leaf", "bucket", F.col("p.key").alias("family")), ["bucket", "leaf"]).select("leaf", "key", "family").distinct()
        lines = left.select("leaf", "key", "line")
        pairs = pairs.join(lines, ["key", "leaf"]).join(lines.select("leaf", F.col("key").alias("family"), F.col("line").alias("pattern")), ["family", "leaf"])
        pairs = stored(pairs.where(_agreeing(F.col("line"), F.col("pattern"), spec)).select("leaf", "key", "family"), "line_pairs")
        best = pairs.join(reaching(pairs, "family"), ["family", "leaf"]).groupBy("leaf", "key").agg(F.min(F.struct(-F.col("n"), "family")).alias("p"))
        best = stored(best.select("leaf", "key", F.col("p.family").alias("family")), "line_best")
        now = stored(best.join(reaching(best, "family"), ["family", "leaf"]).select("leaf", "key", "family"), "line_families")
        found = now if found is None else found.union(now)
        if now.isEmpty():
            return found
        # Only leaves that found a template can find another one.
        open_ = now.select("leaf").distinct()
        left = left.join(docs.select("leaf", "key"), ["key", "leaf"], "semi").join(open_, "leaf").join(now, ["key", "leaf"], "anti")
        left = stored(left, "line_texts_left")


def _crowded_lines(docs: DataFrame, spec: LineSpec) -> DataFrame:
    """(leaf, key, doc_id, _doc, pos, line, long) of the lines in leaves that
    may hold a recurring one, with their variable fields masked.

    Leaves follow from the first tokens and are counted first. Few are crowded,
    and only their lines are looked at as a whole.
    """
    line = F.col("line")
    # What a row is called is worked out once a text, and only the lines go on.
    rows = docs.where("text is not null").select("doc_id", _row(docs).alias("_doc"), _split(F.col("text")).alias("lines"))
    # A text has a line at least; the outer form spares the filter that would split it once more to see that.
    lines = rows.select("doc_id", "_doc", F.posexplode_outer("lines").alias("pos", "line"))
    lines = lines.withColumn("line", _spaced(line)).withColumn("n", _tokens(line))
    places = lines.select("doc_id", "_doc", "pos", _leaf(spec).alias("leaf"), (F.col("n") >= spec.long_words).alias("long"))
    blank = docs.sparkSession.range(1).select(F.xxhash64(F.lit(1), F.lit("")).alias("leaf")).head()["leaf"]
    places = stored(places, "line_leaves").where(F.col("leaf") != blank)
    crowded = places.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), spec.enough().alias("enough"), F.min("_doc").alias("low"), F.max("_doc").alias("high")
    )
    crowded = crowded.where("n >= enough and (low < high or enough = 1)").select("leaf")
    # The text of the lines comes from their documents. The places grow with
    # the documents, so they are never broadcast.
    wanted = places.join(crowded, "leaf").groupBy("_doc", "doc_id").agg(F.collect_set("pos").alias("at"))
    wanted = wanted.select(F.col("_doc").alias("_of"), F.col("doc_id").alias("_id"), "at").hint("merge")
    texts = docs.where("text is not null").select("doc_id", "text", _row(docs).alias("_doc"))
    found = wanted.join(texts, (F.col("_of") == F.col("_doc")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    found = found.select("doc_id", "_doc", "at", _split(F.col("text")).alias("lines"))
    found = found.select("doc_id", "_doc", "lines", F.explode("at").alias("pos"))
    found = found.withColumn("line", _spaced(F.element_at("lines", F.col("pos") + 1))).drop("lines")
    found = found.withColumn("n", _tokens(line)).withColumn("leaf", _leaf(spec)).withColumn("line", _masked(line))
    return found.select("leaf", F.xxhash64("line").alias("key"), "doc_id", "_doc", "pos", "line", _long(line, F.col("n"), spec).alias("long"))


def recurring_lines(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """(doc_id, _doc, pos) of the lines to drop."""
    held = stored(_crowded_lines(docs, spec), "line_keys")
    # Again by documents, now that the lines are known: repeats within one don't count.
    full = held.groupBy("leaf", "_doc").agg(F.max("long").alias("long")).groupBy("leaf")
    full = full.agg(F.count(F.lit(1)).alias("n"), spec.enough().alias("enough")).where("n >= enough")
    held = held.join(stored(full.select("leaf"), "line_full_leaves"), "leaf")
    variants = held.groupBy("leaf", "key").agg(F.count_distinct("_doc").alias("documents"), F.first("line").alias("line"), F.max("long").alias("long"))
    variants = stored(variants, "line_variants")
    held = stored(held.drop("line"), "line_places")
    mixed = variants.groupBy("leaf").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    mixed = stored(variants.join(mixed.select("leaf"), "leaf"), "line_mixed_variants")
    joined = _families(mixed, held, spec)
    members = held.join(joined, ["key", "leaf"], "left").withColumn("family", F.coalesce("family", "key"))
    members = stored(members, "line_members")
    templates = (
        members.groupBy("leaf", "family", "_doc")
        .agg(F.min("doc_id").alias("doc_id"), F.max("long").alias("long"))
        .groupBy("leaf", "family")
        .agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"), spec.enough().alias("enough"))
        .where("documents >= enough")
    )
    return (
        members.join(templates, ["family", "leaf"])
        .where("first is not null and (doc_id is null or doc_id > first)")
        .select("doc_id", "_doc", "pos")
    )


def line_dedup(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """The rows of ``docs`` with the text that is left, ``n_lines`` and ``n_dropped``.

    Null texts stay null with no lines; an empty text is one empty line. Lines
    without a token are never dropped. Repeated rows count as one document; of
    rows that share an id but not the text each counts. The first document is
    the one of the smallest id, null ids come last. All other columns stay,
    but for n_lines and n_dropped, which are replaced.
    """
    docs = without(docs, ["n_lines", "n_dropped"])
    dropped = recurring_lines(docs.select("doc_id", "text"), spec).groupBy("_doc", "doc_id").agg(F.collect_set("pos").alias("gone"))
    dropped = dropped.select(F.col("_doc").alias("of"), F.col("doc_id").alias("id"), "gone").hint("merge")
    rows = packed(docs).withColumn("row", _row(docs)).join(dropped, (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    out = rows.withColumns(
        {
            "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
            "n_lines": F.coalesce(_parts(F.col("text"), "\n"), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.array_size("gone"), F.lit(0)).cast("long"),
        }
    )
    return unpacked(out, docs.columns, "n_lines", "n_dropped")


def digest(left: DataFrame) -> DataFrame:
    return left.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
