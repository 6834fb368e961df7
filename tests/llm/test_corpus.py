"""Operators that compare documents with each other, and the pipeline."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm import graph, line_templates, near_dups, sentence_spans, suffixes
from emberline.sources.writers import stored
from tests.llm.cases import frame, odd_rows, rows_of

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- near duplicates --------------------------------------------------------------


def plain_components(rows):
    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    common = Counter((a, b) for at in inverted.values() for k, a in enumerate(at) for b in at[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(b)] = root(a)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    return sorted(((d, len(sets[i]), min(ids[root(i)]), d == min(ids[root(i)])) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 300)}" for _ in range(160)]
    for i in range(120):  # one large group about the threshold, with copies
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"v{draw.randint(0, 5000)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000 + i, " ".join(base)) for i in range(5)] + [(30_000, "a b"), (30_001, "A b"), (30_002, "a b c"), (30_003, ""), (30_004, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    want = plain_components(rows)
    assert rows_of(near_dups.digest(near_dups.near_duplicates(docs))) == want
    # Other numbers of pivots.
    for spec in (near_dups.NearSpec(pivots=1), near_dups.NearSpec(pivots=3, small=0, block=8)):
        assert rows_of(near_dups.digest(near_dups.near_duplicates(docs, spec))) == want


def test_near_duplicates_keep_the_columns_of_the_caller(spark):
    rows = [(f"k{i}", "a b c d e f" if i < 3 else f"w{i} x y z", i, i * 2, "c") for i in range(6)]
    docs = frame(spark, rows, "doc_id string, text string, _id long, _node long, node string")
    found = near_dups.near_duplicates(docs)
    assert found.columns == [*docs.columns, "n_shingles", "component_id", "kept"]
    assert rows_of(found.select("doc_id", "_id", "_node", "node", "component_id")) == [
        (f"k{i}", i, i * 2, "c", "k0" if i < 3 else f"k{i}") for i in range(6)
    ]


def test_near_duplicates_of_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("component_id", F.lit("clash"))
    found = near_dups.near_duplicates(docs)
    assert found.count() == len(odd_rows()) and found.where("not kept").count() == 0
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    spec = near_dups.NearSpec()
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    other = list(words)
    for i in draw.sample(range(400), 12):
        other[i] = "x"
    pair = [near_dups.signature(" ".join(w), spec)[2] for w in (words, other)]
    row = frame(spark, [tuple(pair)], "a array<long>, b array<long>").select(near_dups.estimate(F.col("a"), F.col("b"), spec).alias("e")).first()
    s, t = (set(zip(*[w[i:] for i in range(5)])) for w in (words, other))
    assert abs(row.e - len(s & t) / len(s | t)) < 0.2


def test_members_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """Pairs of a large group that are similar but not enough were one row each."""
    draw = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(100):
        words = list(base)
        for at in draw.sample(range(30), 7):
            words[at * 5] = f"v{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[50][1] + " one more"), (201, rows[70][1] + " and another")]
    counts = []
    whole = near_dups._confirmed_in_blocks

    def counted(pairs, texts, spec):
        counts.append(pairs.count())
        return whole(pairs, texts, spec)

    monkeypatch.setattr(near_dups, "_confirmed_in_blocks", counted)
    docs = frame(spark, rows, "doc_id long, text string")
    assert rows_of(near_dups.digest(near_dups.near_duplicates(docs))) == plain_components(rows)
    assert sum(counts) < len(rows)


def test_parities_rule_out_no_similar_pair(spark):
    spec = near_dups.NearSpec()
    draw = random.Random(9)
    pairs = []
    for n in (3, 15, 16, 17, 60, 63, 64, 65, 90, 127, 128, 129, 130, 500):
        for _ in range(12):
            some = {draw.getrandbits(64) for _ in range(n)}
            gone = draw.randint(0, max(1, n // 3))
            other = set(draw.sample(sorted(some), n - min(gone, n - 1))) | {draw.getrandbits(64) for _ in range(draw.randint(0, n // 3))}
            x, y = (np.array(sorted(v), np.uint64) for v in (some, other))
            pairs.append((len(some & other) * 100 >= 75 * len(some | other), len(x), near_dups.parities(x).tolist(), len(y), near_dups.parities(y).tolist()))
    sets = frame(spark, pairs, "similar boolean, nx long, x array<long>, ny long, y array<long>")
    sets = sets.withColumn("hx", near_dups._halved("x")).withColumn("hy", near_dups._halved("y"))
    told = sets.select("similar", near_dups._within("nx", "x", "hx", "ny", "y", "hy", spec).alias("within"), (F.size("x") == F.size("y")).alias("even"))
    found = Counter((r.similar, r.within, r.even) for r in told.collect())
    assert all(found[True, True, even] and not found[True, False, even] for even in (True, False))
    assert found[False, False, True] > 9 * found[False, True, True]


# -- lines -------------------------------------------------------------------------


def test_lines_with_variable_fields_go_from_all_but_the_first(spark):
    names = "ada bob cid dan eve fay gus hal".split()
    rows = []
    for i in range(40):
        own = f"body number {'abcdefghij'[i % 10]} of its kind {i * 7919} with words of document {chr(97 + i % 26)}{i // 26} only"
        rows.append((i, f"{own}\nPosted 2024-01-{i % 28 + 1:02d} by reader {i} now\nWritten all for us by {names[i % 8]}\nshared line"))
    spec = line_templates.LineSpec(documents=20)
    left = {r.doc_id: r for r in line_templates.line_dedup(frame(spark, rows, "doc_id long, text string"), spec).collect()}
    assert left[0].n_dropped == 0 and left[0].text == rows[0][1]
    for i in range(1, 40):
        assert "shared line" not in left[i].text and "Posted" not in left[i].text and "body number" in left[i].text
        assert "Written" not in left[i].text and left[i].n_lines == 4


def test_lines_of_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("n_lines", F.lit("clash"))
    left = line_templates.line_dedup(docs, line_templates.LineSpec(documents=2))
    assert rows_of(left.select("doc_id", "text")) == rows_of(docs.select("doc_id", "text"))
    assert line_templates.line_dedup(docs.limit(0)).count() == 0


def test_every_template_of_a_leaf_is_found(spark):
    def name(i):
        return "".join(chr(97 + int(d)) for d in f"{i:04d}")

    rows = [(i, f"Posted by reader {name(i)} from our old town") for i in range(100)]
    rows += [(200 + i, f"Posted by reader and printed with {name(i)} change") for i in range(40)]
    # A field that stands in other lines, too, and one whose places differ by line.
    rows += [(300 + i, f"Posted by reader {name(i % 4)} from {name(900 + i)} hill {name(950 + i)}") for i in range(30)]
    line = "Posted by reader in the evening paper of all our towns and hills".split()
    for i in range(40):
        own = list(line)
        own[3 + i % 10] = name(500 + i)
        rows.append((400 + i, " ".join(own)))
    # The smallest text, as frequent as any other; and a list within one document.
    rows += [(600, "Posted by reader Aaa and Bbb or Ccc"), (601, "\n".join(f"Posted by reader who has {name(i)} for us" for i in range(30)))]
    left = {r.doc_id: r.n_dropped for r in line_templates.line_dedup(frame(spark, rows, "doc_id long, text string")).collect()}
    gone = {d for d, n in left.items() if n}
    assert gone == {*range(1, 100), *range(201, 240), *range(401, 440)}


def test_long_lines_recur_in_few_documents(spark):
    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    other = long.upper()
    numbers = [" ".join(str(i * k) for i in range(60)) for k in (1, 2)]
    rows = [
        (1, f"{long}\nshort line\n{numbers[0]}"),
        (2, f"first here\n{long}\nshort line\n{numbers[1]}"),
        (3, f"{long.replace('wbb', 'else')}\nshort line"),
        (4, f"{other}\n{other}"),  # twice, but in one document
    ]
    left = {r.doc_id: r.n_dropped for r in line_templates.line_dedup(frame(spark, rows, "doc_id long, text string")).collect()}
    assert left == {1: 0, 2: 1, 3: 1, 4: 0}


def spark_hash(*values):
    """The hash that orders equally good lines: of whole numbers and texts, one seeding the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain_lines(rows, spec=line_templates.LineSpec()):
    """{doc_id: places of the lines that go}, by the same rounds over plain sets."""
    lines = []
    for d, text in set(rows):
        for pos, line in enumerate([] if text is None else text.split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))
            if tokens:
                long = len(tokens) >= spec.long_words and sum(t != "<*>" for t in tokens) >= spec.long_words
                lines.append(((len(tokens), tokens[: spec.depth]), tokens, d, pos, long))
    by_leaf = defaultdict(list)
    for leaf, *rest in lines:
        by_leaf[leaf].append(rest)
    gone = defaultdict(set)
    for held in by_leaf.values():
        docs, long = defaultdict(set), {}
        for t, d, _, wide in held:
            docs[t].add(d)
            long[t] = wide

        def enough(ts):
            return min(spec.long_documents, spec.documents) if any(long[t] for t in ts) else spec.documents

        def reached(groups):
            """The documents of the groups that have enough."""
            out = {g: len(set().union(*[docs[t] for t in ts])) for g, ts in groups.items()}
            return {g: n for g, n in out.items() if n >= enough(groups[g])}

        def grouped(pairs):
            out = defaultdict(set)
            for t, g in pairs:
                out[g].add(t)
            return out

        family, left, known = {}, set(docs), None
        while reached({0: set(docs)}) and len(docs) > 1:
            n = len(held[0][0])
            fields = n * (spec.agree[1] - spec.agree[0]) // spec.agree[1]
            if not fields or n <= spec.depth:
                break
            seen = Counter()
            for t in left:
                for x in enumerate(t[spec.depth :], spec.depth):
                    seen[x] += len(docs[t])
            buckets = []
            for t in left:
                open_ = sorted(enumerate(t[spec.depth :], spec.depth), key=lambda x: (seen[x], spark_hash(*x)))
                for k in range(1, fields + 1):
                    buckets.append((t, ("masked", frozenset(open_[k:]))))
                for b in range(fields + 1):
                    free = n - spec.depth
                    i, j = b * free // (fields + 1), (b + 1) * free // (fields + 1)
                    buckets.append((t, ("band", b, t[spec.depth + i : spec.depth + j])))
            full = {g: ts for g, ts in grouped(buckets).items() if len(ts) > 1 and sum(len(docs[t]) for t in ts) >= enough(ts)}
            if known is None:
                known = set().union(*full.values())
            sizes = reached(full)
            full = {g: full[g] for g in sizes}
            score = defaultdict(int)
            for g, ts in full.items():
                for t in ts:
                    score[t] = max(score[t], sizes[g] if g[0] == "masked" else len(docs[t]))
            pairs = set()
            for g, ts in full.items():
                pivot = min(ts, key=lambda t: (-score[t], -len(docs[t]), spark_hash(" ".join(t))))
                pairs |= {(t, pivot) for t in ts if spec.agree[1] * sum(a == b for a, b in zip(t, pivot)) >= spec.agree[0] * n}
            sizes = reached(grouped(pairs))
            best = {}
            for t, p in pairs:
                if p in sizes:
                    best[t] = min(best.get(t, (0, 0, ())), (-sizes[p], spark_hash(" ".join(p)), p))
            joined = grouped((t, p[2]) for t, p in best.items())
            now = {t: p for p in reached(joined) for t in joined[p]}
            family |= now
            left = (left & known) - set(now)
            if not now:
                break
        templates = grouped((t, family.get(t, t)) for t in docs)
        for p in reached(templates):
            owners = set().union(*[docs[t] for t in templates[p]])
            first = min((d for d in owners if d is not None), default=None)
            for t, d, pos, _ in held:
                if t in templates[p] and first is not None and (d is None or d > first):
                    gone[d].add(pos)
    return gone


def lines_left(rows, gone):
    out = []
    for d, text in rows:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[d])
        out.append((d, kept if gone[d] else text, len(gone[d])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_plain_rounds(spark, seed):
    draw = random.Random(seed)

    def word():
        return "".join(draw.choice("abc") for _ in range(3))

    stock = []
    for n in (4, 9, 9, 9, 15, 55, 60):
        base = ["same", "first", "words"] + [word() for _ in range(n - 3)]
        for _ in range(draw.randint(2, 8)):
            line = list(base)
            for _ in range(draw.randint(0, n // 4)):
                line[draw.randrange(3, n)] = draw.choice([word(), str(draw.randint(0, 99)), "x"])
            stock.append(line)
    rows = []
    for d in range(90):
        lines = [draw.choice(["", "\t", " "]) + draw.choice([" ", "  ", "\t"]).join(draw.choice(stock)) for _ in range(draw.randint(0, 4))]
        rows.append((d, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (7, rows[7][1])]
    spec = line_templates.LineSpec(documents=6)
    gone = plain_lines(rows, spec)
    left = line_templates.line_dedup(frame(spark, rows, "doc_id long, text string"), spec)
    assert rows_of(left.select("doc_id", "text", "n_dropped")) == lines_left(rows, gone)
    assert sum(map(len, gone.values())) > 20


def test_lines_of_the_documents_equal_plain_rounds(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    left = line_templates.line_dedup(documents(spark))
    assert rows_of(left.select("doc_id", "text", "n_dropped")) == lines_left(rows, plain_lines(rows))


def test_line_operator_keeps_the_columns_of_the_caller(spark):
    rows = [(i, "one line for all of us\nown " + "abcdefghijklmnopqrstuvwxyz"[i], i * 10, [str(i)], i, "p") for i in range(25)]
    docs = frame(spark, rows, "doc_id long, text string, _doc long, _lines array<string>, line long, _pos string")
    left = line_templates.line_dedup(docs).collect()
    assert {(r.doc_id, r._doc, r._lines[0], r.line, r._pos) for r in left} == {(i, i * 10, str(i), i, "p") for i in range(25)}
    assert sum(r.n_dropped for r in left) == 24


def test_lines_and_tokens_are_counted_in_bytes(spark):
    """Counting the characters of every line took a fifth of the first stage."""
    rows = [(0, "é 日 ▁  😀"), (1, ""), (2, "\n"), (3, "é\n\nb 日\n"), (4, None), (5, "a\r\nb"), (6, " x ")]
    docs = frame(spark, rows, "doc_id long, text string")
    found = line_templates.line_dedup(docs).select("doc_id", "n_lines")
    assert rows_of(found) == [(i, 0 if t is None else len(t.split("\n"))) for i, t in rows]
    lines = [("é 日 ▁ 😀", 4), ("x", 1), ("a  b\u2003c d", 3), ("  日  é ", 2)]
    told = frame(spark, lines, "line string, n int").withColumn("line", line_templates._spaced(F.col("line")))
    assert told.where(line_templates._tokens(F.col("line")) != F.col("n")).count() == 0
    assert "octet_length" in str(line_templates._tokens(F.col("line")))


def noted_tables(monkeypatch):
    """{name: the tables of that name that the line operator stores}, filled as it runs."""
    tables, store = defaultdict(list), line_templates.stored

    def noting(df, name):
        tables[name].append((df, store(df, name)))
        return tables[name][-1][1]

    monkeypatch.setattr(line_templates, "stored", noting)
    return tables


def test_texts_are_split_once_for_their_leaves(spark, monkeypatch):
    """A filter on the number of lines split every text a second time."""
    tables = noted_tables(monkeypatch)
    line_templates.line_dedup(documents(spark))
    plan = tables["line_leaves"][0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "size(" not in plan


def test_buckets_of_the_same_lines_are_kept_once(spark, monkeypatch):
    """Long lines that differ in a token met in most of their buckets, 24 here."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(d, " ".join(words[:30] + [own] + words[31:])) for d, own in enumerate(("one", "two", "two"))]
    rows += [(9, " ".join(words[:40] + ["other"] + words[41:]))]
    tables = noted_tables(monkeypatch)
    left = {r.doc_id: r.n_dropped for r in line_templates.line_dedup(frame(spark, rows, "doc_id long, text string")).collect()}
    assert left == {0: 0, 1: 1, 2: 1, 9: 1}
    members = defaultdict(set)
    for r in tables["line_crowded_buckets"][0][1].collect():
        members[r.leaf, r.bucket].add(r.key)
    assert sorted(map(len, members.values())) == [2, 3]


def test_line_plan_is_native(spark):
    plan = line_templates.line_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- sentence spans -------------------------------------------------------------------


def plain_spans(rows):
    """Sentences, then runs of three, or of two with twenty words; the first
    document and place keeps a run."""

    def cut(text):
        out = re.findall(r"(?s)(?:(?![.!?][\x20\x09-\x0D]|\n).)*(?:[.!?][\x20\x09-\x0D]|\n)|.+", text or "")
        return out

    seen, drops = {}, defaultdict(set)
    split = {d: cut(t) for d, t in rows}
    for d, _ in sorted(rows):
        s = split[d]
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), x).split() for x in s]
        real = [i for i, w in enumerate(words) if w]
        for n, least in ((3, 0), (2, 20)):
            for k in range(len(real) - n + 1):
                inside = real[k : k + n]
                run = tuple(w for i in inside for w in words[i])
                if len(run) < least:
                    continue
                if (n, run) in seen:
                    drops[d] |= set(range(inside[0], inside[-1] + 1))
                else:
                    seen[n, run] = d
    return sorted(((d, "".join(x for i, x in enumerate(split[d]) if i not in drops[d])) for d, _ in rows), key=str)


def test_spans_equal_plain_version(spark):
    draw = random.Random(6)
    stock = [" ".join(f"w{draw.randint(0, 40)}" for _ in range(draw.randint(1, 14))) + draw.choice([".", "!", "?"]) for _ in range(40)]
    rows = [(i, "".join(draw.choice(stock) + draw.choice([" ", "\n", " "]) for _ in range(draw.randint(0, 12)))) for i in range(120)]
    rows += [(200, " ".join(stock[:6])), (201, "Before this. " + " ".join(stock[:6]) + " After it."), (202, " ".join(stock[:6] * 2))]
    left = sentence_spans.substring_dedup(frame(spark, rows, "doc_id long, text string"))
    assert rows_of(left.select("doc_id", "text")) == plain_spans(rows)


def test_long_single_sentences_go(spark):
    long = " ".join(f"w{i}" for i in range(60))
    short = " ".join(f"s{i}" for i in range(39)) + "."
    rows = [(1, f"One here. {long}. {short} More of it."), (2, f"Two there. {long.upper()}. Then {short}"), (3, f"{long}.")]
    left = {r.doc_id: r.text for r in sentence_spans.substring_dedup(frame(spark, rows, "doc_id long, text string")).collect()}
    assert left == {1: rows[0][1], 2: f"Two there. Then {short}", 3: ""}


def test_spans_keep_the_columns_of_the_caller(spark):
    rows = [(i, "One two three. Four five six. Seven eight nine." + f" Own {i}.", i, i + 1, i + 2) for i in range(3)]
    left = sentence_spans.substring_dedup(frame(spark, rows, "doc_id long, text string, _text long, _both long, _key long")).collect()
    assert {(r.doc_id, r._text, r._both, r._key, r.n_removed) for r in left} == {(0, 0, 1, 2, 0), (1, 1, 2, 3, 3), (2, 2, 3, 4, 3)}


def test_spans_of_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("n_removed", F.lit("clash"))
    left = {r.doc_id: r for r in sentence_spans.substring_dedup(docs).where("doc_id is not null").collect()}
    assert left[1].text is None and left[2].text == "" and left[6].n_removed == 0 and left[5].n_removed > 3000
    assert sentence_spans.substring_dedup(docs).count() == len(odd_rows())
    assert sentence_spans.substring_dedup(docs.limit(0)).count() == 0


# -- suffixes ---------------------------------------------------------------------------


def plain_suffixes(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_equal_all_windows(spark, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abé ") for _ in range(900)) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(draw.randint(0, 4)):
            i = draw.randint(0, 500)
            parts.append(draw.choice(base)[i : i + draw.randint(100, 700)])
            parts.append("".join(draw.choice("xyz") for _ in range(draw.randint(0, 60))))
            if draw.random() < 0.2:
                parts.append(draw.choice(["q", "uv", "lmn"]) * draw.randint(50, 600))
        text = list("".join(parts))
        for _ in range(draw.randint(0, 2)):
            if text:
                text[draw.randrange(len(text))] = "#"
        rows.append((d, "".join(text)))
    rows += [(100, None), (101, ""), (3, rows[3][1]), (None, rows[5][1])]
    docs = frame(spark, rows, "doc_id long, text string")
    found = suffixes.digest(suffixes.suffix_dedup(docs))
    assert rows_of(found.drop("n_shared")) == plain_suffixes(rows, 400)
    # A text with a string of 240 bytes that another has shares one that is noted.
    raws = [(t or "").encode() for _, t in rows]
    owners = defaultdict(set)
    for k, r in enumerate(raws):
        for i in range(len(r) - 239):
            owners[r[i : i + 240]].add(k)
    sharing = set().union(*[o for o in owners.values() if len(o) > 1])
    noted = {(r.doc_id, r.n_bytes) for r in found.where("n_shared > 0").collect()}
    assert {(rows[k][0], len(raws[k])) for k in sharing} <= noted


def test_suffixes_are_ordered_and_neighbours_compared(spark):
    words = ["banana", "bandana", "ananas", "banana", "nab", "anan", "banana", "ananas"]
    starts = frame(spark, [(w, i) for i, w in enumerate(words)], "head string, first long").repartition(3)
    ordered = suffixes.merged(starts, ["head"], ["first"])
    assert [r["head"] for r in ordered.orderBy("part", "row").collect()] == sorted(words)
    equal = suffixes.with_equal_neighbour(ordered, ["head"])
    assert sorted(r["first"] for r in equal.collect()) == [0, 2, 3, 6, 7]
    # Equal rows in every range, and ranges of one row.
    many = frame(spark, [("same", i) for i in range(40)] + [("other", 50)], "head string, first long").repartition(5)
    equal = suffixes.with_equal_neighbour(suffixes.merged(many, ["head"], ["first"]), ["head"])
    assert sorted(r["first"] for r in equal.collect()) == list(range(40))


def test_core_names_ascend_as_the_cores(spark):
    draw = random.Random(8)
    spec = suffixes.SuffixSpec()
    cores = [bytes(draw.choice(b"ab") for _ in range(spec.core)) for _ in range(12)]
    cores += [cores[0][:-1] + b"z", cores[3], cores[4][:200] + b"z" + cores[4][201:]]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cores)], "piece long, core binary")
    names = {r["piece"]: r["name"] for r in suffixes.core_names(rows, spec).collect()}
    assert len(names) == len(cores)
    for i, a in enumerate(cores):
        for j, b in enumerate(cores):
            assert (names[i] < names[j]) == (a < b)


def test_suffixes_of_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("removed", F.lit("clash")).withColumn("_doc", F.lit("own")).withColumn("both", F.lit(1))
    assert {(r._doc, r.both) for r in suffixes.suffix_dedup(docs).collect()} == {("own", 1)}
    left = {r.doc_id: r for r in suffixes.suffix_dedup(docs).collect()}
    assert left[4].n_bytes == 100_000 and len(left[4].kept) == 0 and left[1].kept == b"" and left[6].removed == []
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0


# -- pipeline -----------------------------------------------------------------------------


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = frame(spark, odd_rows()).withColumn("kept", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("n_dropped", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            assert out.count() <= rows.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece",
    ]


def test_pipeline_decides_as_plain_versions(spark):
    """After the rules, each stage's rows equal a plain version's."""
    docs = corpus_pipeline.rules(spark, documents(spark), SF).cache()
    one_each = {d for d, _, _, kept in plain_components([(r.doc_id, r.text) for r in docs.collect()]) if kept}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()} == one_each
    clean = {r.doc_id for r in corpus_pipeline.leaks(spark, docs, SF).collect()}
    from tests.llm.test_texts import plain_leaks

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean == {r.doc_id for r in docs.collect() if not plain_leaks(r.text, items)[-1]}



def test_no_table_is_made_of_a_long_plan(spark, monkeypatch):
    """The driver holds every plan, each of its adaptive versions, and what it
    keeps of both; a part that is read again is a table of its own."""
    scans = {}

    def noted(df, name):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        scans[name] = max(leaves, scans.get(name, 0))
        return stored(df, name)

    for module in (graph, line_templates, near_dups):
        monkeypatch.setattr(module, "stored", noted)
    docs = documents(spark)
    noted(line_templates.line_dedup(docs), "lines")
    noted(near_dups.near_duplicates(docs), "near")
    assert {name: n for name, n in scans.items() if n > 7} == {}
