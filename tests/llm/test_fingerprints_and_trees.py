"""Whitening, fingerprints and the manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import fingerprints, graph, merkle, whitening
from emberline.sources import writers
from tests.llm.cases import frame, odd_rows, rows_of

SF = "/root/testdata/sf0.001"


# -- whitening --------------------------------------------------------------------


def plain_whitening(vectors, components=4):
    """(x, deviation, whitened, explained) of each vector, by exact fractions
    of plain products."""
    rows = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, rows)))
    n, size = len(fit), len(rows[0])
    sums = [sum(x[i] for x in fit) for i in range(size)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(size)] for i in range(size)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    white = np.array([[float(a - m) for a, m in zip(x, mean)] for x in rows]) @ axes / np.sqrt(e)
    return n, [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in rows], white, e / np.trace(v)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, _x string")


def held_against(found, vectors, ids):
    n, deviation, white, explained = plain_whitening(vectors)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == len(ids) * white.shape[1]
    for c in range(white.shape[1]):
        got = np.array([by[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(got - white[:, c]).max(), np.abs(got + white[:, c]).max()) < 1e-8
    for i, d in zip(ids, deviation):
        assert by[i, 1]["n"] == n and by[i, 1]["deviation"] == d
        assert by[i, 1]["explained"] == pytest.approx(explained[0], rel=1e-9)
        assert by[i, 1]["identity_error"] < 1e-9


def test_whitening_equals_plain_covariance(spark):
    draw = random.Random(1)
    vectors = [[draw.gauss(i, i + 1) for i in range(6)] for _ in range(60)]
    vectors = [[float(np.float32(c)) for c in v] for v in vectors] + [[0.5, -0.25, -0.0, 1.0, 2.0, 3.0]] * 30
    rows = [(i, v, "caller's", "x") for i, v in enumerate(vectors)]
    odd = [(900, None, "", ""), (901, [], "", ""), (902, [1.0] * 5 + [None], "", ""), (903, [float("nan")] * 6, "", ""), (904, [float("inf")] * 6, "", ""), (905, [1.0, 2.0], "", "")]
    found = whitening.whiten(embeddings(spark, rows + odd))
    assert found.columns == ["vec_id", "embedding", "_x", *whitening.COLUMNS]
    out = found.collect()
    assert {r["_x"] for r in out} == {"x"}
    held_against(out, vectors, list(range(len(vectors))))


def test_whitening_of_large_entries_is_exact(spark):
    draw = random.Random(2)
    vectors = [[draw.randint(-(2**43), 2**43) + 0.0 for _ in range(3)] for _ in range(12)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = whitening.whiten(rows).collect()
    _, deviation, _, _ = plain_whitening(vectors)
    by = {r["vec_id"]: r["deviation"] for r in out}
    assert [by[i] for i in range(12)] == [d if d < 10**38 else None for d in deviation]
    assert all(r["identity_error"] < 1e-9 for r in out)


def test_polarised_sums_give_the_covariance(spark):
    rows = [[1, 5, -3], [2, 5, 4], [7, 5, 0], [-4, 5, 11]]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<bigint>")
    sums = tuple(sum(c) for c in zip(*rows))
    squares = {}
    for r in whitening.polarised(fit, len(rows), sums).collect():
        squares[r["i"], r["j"]] = squares.get((r["i"], r["j"]), 0) + (int(r["total"]) << r["shift"])
    z = [[len(rows) * a - s for a, s in zip(r, sums)] for r in rows]
    assert squares[0, 2] == sum((r[0] + r[2]) ** 2 for r in z)
    assert np.allclose(whitening.covariance(squares, len(rows), 3), np.cov(np.array(rows).T, bias=True))


def test_whitening_without_spread_or_rows(spark):
    same = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])).collect()
    assert len(same) == 4 and {(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same} == {(1, 0, None, None)}
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.digest(whitening.whiten(embeddings(spark, [(1, None, "", "")]))).collect() == []


# -- fingerprints -----------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, ids):
    least = {}
    for v, i in zip(values, ids):
        if i is not None:
            least[v] = min(i, least.get(v, i))
    parent = {v: v for v in least}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    distinct = list(least)
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    group = {}
    for v, i in least.items():
        group[root(v)] = min(i, group.get(root(v), i))
    return [None if i is None else group[root(v)] for v, i in zip(values, ids)]


def test_fingerprints_equal_plain_ones(spark):
    assert spark.sql("select xxhash64('some three words') as h").head()["h"] % 2**64 == xxhash.xxh64_intdigest(b"some three words", 42)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(frame(spark, odd_rows()).select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    values = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(values, [d for d, _ in rows])
    wanted = sorted(((d, f"{v:016x}", c) for (d, _), v, c in zip(rows, values, groups)), key=str)
    assert rows_of(fingerprints.sim_duplicates(docs)) == wanted


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("few", [32, 4])
def test_links_of_crowded_keys_equal_all_pairs(spark, few):
    draw = random.Random(3)
    centre = draw.getrandbits(64)
    values = {centre, 0, 1, 3, (1 << 64) - 1}
    while len(values) < 700:  # many that agree in one half or nearly so
        v = centre
        for _ in range(draw.randint(1, 5)):
            v ^= 1 << draw.choice([*range(64), *range(40, 50), *range(40, 50)])
        values.add(v)
    values |= {draw.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    nodes = spark.createDataFrame([(signed(v), signed(v)) for v in values], "node long, bits long")
    found = fingerprints.links(nodes, fingerprints.SimSpec(few=few))
    got = {frozenset((r["a"], r["b"])) for r in found.collect()}
    wanted = {frozenset((signed(a), signed(b))) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 2}
    assert got == wanted and len(wanted) > 1000


def noted_plans(monkeypatch, *modules):
    """The plans of the tables that these modules store, filled as they run."""
    plans = []

    def noting(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return writers.stored(df, name)

    for module in modules:
        monkeypatch.setattr(module, "stored", noting)
    return plans


def test_unfolded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes 34 keys of a fingerprint for as large as the fingerprint."""
    nodes = spark.range(3000).select(F.xxhash64("id").alias("bits"), F.col("id").alias("doc_id"))
    plans = noted_plans(monkeypatch, fingerprints)
    found = fingerprints.near_fingerprints(nodes.union(nodes.select(F.col("bits").bitwiseXOR(F.lit(5)), F.col("doc_id") + 3000)))
    assert found.where("component_id = doc_id % 3000").count() == 6000
    pairs = fingerprints._pairs(spark.createDataFrame([(1, None, 5, 1), (1, None, 4, 2)], "key long, side byte, bits long, node long"))
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (found, pairs)]
    assert sum("SortMergeJoin" in p for p in plans) > 2
    assert not any("Broadcast" in p for p in plans)


def test_nodes_of_many_links_are_not_broadcast(spark, monkeypatch):
    """Collected rows are many times the size of the files that Spark goes by."""
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    monkeypatch.setattr(graph, "COLLECTED", 0)
    plans = noted_plans(monkeypatch, graph)
    assert {r["component"] for r in graph.connected(chain).collect()} == {0}
    assert sum("SortMergeJoin" in p for p in plans) > 3
    assert not any("Broadcast" in p for p in plans)


def test_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5, "a", "b", 7), (2, 4, "c", "d", 8), (None, 5, "e", "f", 9)], "doc_id long, bits long, _of string, node string, component_id long")
    found = fingerprints.near_fingerprints(rows)
    assert found.columns == ["doc_id", "bits", "_of", "node", "component_id"]
    assert rows_of(found) == [(1, 5, "a", "b", 1), (2, 4, "c", "d", 1), (None, 5, "e", "f", None)]
    empty = frame(spark, [])
    assert fingerprints.sim_duplicates(empty).collect() == []
    assert merkle.digest(merkle.proofs(empty)).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (2000, 1999)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.connected(links).collect()}
    wanted = {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1200)} | {1999: 1999, 2000: 1999}
    assert found == wanted
    assert graph.connected(links.where("false")).collect() == []


# -- manifest ---------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and the siblings of each node level by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for w, i in zip(ways, at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            w.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], ways


def plain_manifest(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]))) for g in langs}
    trees = {g: plain_tree([plain_leaf(r, r["text"]) for r in order[g]]) for g in langs}
    root, top = plain_tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for r, way in zip(order[g], trees[g][1]):
            way = way + top[k]
            leaf = h = plain_leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                h = plain_leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r["text"]))
            for left, right in way:
                h = sha(left + h + right)
            out.append((r["doc_id"], leaf, trees[g][0], root, sha("".join(a + b for a, b in way)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("langs", [1, 3, 70])
def test_manifest_equals_plain_trees(spark, langs):
    draw = random.Random(langs)
    rows = [(i * 3, f"Text {i} of LANG", f"l{int(draw.random() ** 2 * langs)}", "s" if i % 5 else None, i) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.union(frame(spark, odd_rows()))
    found = merkle.digest(merkle.proofs(docs.withColumn("grp", F.lit(1)), merkle.tampered(F.col("text"), F.col("doc_id"))))
    assert rows_of(found) == plain_manifest(docs.collect())


def test_manifest_of_one_row_and_of_one_group(spark):
    one = frame(spark, [(1, "Only", "en", "a", 4)])
    r = merkle.digest(merkle.proofs(one)).head()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("") and r["verified"]
    copies = frame(spark, [(5, "the same", "en", "a", 8)] * 70)
    assert rows_of(merkle.digest(merkle.proofs(copies))) == plain_manifest(copies.collect())
