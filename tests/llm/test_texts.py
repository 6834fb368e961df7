"""Operators that read each text for itself."""

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from emberline.llm import chat, decontaminate, pii, quality_rules, rule_ensemble, sentencepieces
from tests.llm.cases import frame, odd_rows, rows_of

SF = "/root/testdata/sf0.01"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# -- quality rules ---------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def test_base_counts_equal_plain_counts(spark):
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()] + [r[1] for r in odd_rows()]
    texts += ["a b c a b c a", "#*$ <x>\n#*$ <x>\n\n", "a\x85b c　d"]
    for text in texts:
        assert quality_rules.base_counts(text) == plain_counts(text)


def test_rules_tell_labels_apart_and_survive_odd_rows(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    seen = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    model = quality_rules.fit(docs, seen)
    held = docs.join(labels.join(seen, "doc_id", "left_anti"), "doc_id")
    scored = quality_rules.quality_rules(held, model).select("quality", "probability").collect()
    good = [r.probability for r in scored if r.quality == 1]
    bad = [r.probability for r in scored if r.quality == 0]
    assert sum(p >= 0.3 for p in good) > 0.97 * len(good) and sum(p < 0.3 for p in bad) > 0.8 * len(bad)
    again = quality_rules.RulesModel.from_json(model.to_json())
    assert again.probability("The old mill.") == model.probability("The old mill.")
    odd = frame(spark, odd_rows()).withColumn("KEPT", F.lit("clash"))
    rows = quality_rules.quality_rules(odd, model)
    assert rows.count() == len(odd_rows()) and not rows.where("text is null and kept").count()
    assert quality_rules.quality_rules(odd.limit(0), None).count() == 0


def test_rules_without_labels(spark):
    docs = frame(spark, odd_rows())
    assert quality_rules.fit(docs, frame(spark, [], "doc_id long, quality int")) is None
    assert quality_rules.fit(docs, frame(spark, [(5, 1), (None, 0), (6, None)], "doc_id long, quality int")) is None
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, None).where("kept").collect()}
    assert kept == set()  # the long text repeats itself


# -- personal data -----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    tests = {
        "email": (EMAIL, lambda s: True),
        "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": (PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in tests.items() for m in p.finditer(text or "") if ok(m.group())]


def test_base_spans_equal_the_patterns(spark):
    texts = [r["text"] for r in table(spark, "documents").select("text").collect()]
    draw = random.Random(3)
    texts += ["".join(draw.choice("ab@.-+ 0125()\n%é") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8.9", "a@b@c.d.e", "x@y.z@w.v", "0001.02.003.4", "4111 1111-1111 1111", "+1 (415) 555-2671.", None, ""]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_texts_take_no_quadratic_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000, "1 " * 100_000):
        pii.base_spans(text)


def planted(draw, words):
    """A text with one item of each kind, disguised, and where they are."""

    def number(n):
        return "".join(str(draw.randint(0, 9)) for _ in range(n))

    card = next(c for c in (f"4{number(15)}" for _ in range(200)) if pii.luhn(c))
    items = [
        ("email", f"{draw.choice(words).lower()}.{number(2)}@mail{number(1)}.example.com"),
        ("ip", ".".join(str(draw.randint(1, 255)) for _ in range(4))),
        ("card", card),
        ("phone", f"+1 ({number(3)}) 555-{number(4)}"),
    ]
    draw.shuffle(items)
    text, spans = "", []
    for kind, item in items:
        text += " ".join(draw.choice(words) for _ in range(draw.randint(5, 40))) + " "
        spans.append((kind, len(text), len(text) + len(item)))
        text += item + draw.choice([" ", ". ", ", "])
    text, spans = pii.disguised(text, spans)
    secret = "".join(draw.choice("0123456789abcdef") for _ in range(40))
    text += 'token = "'
    return f'{text}{secret}" and on', [*spans, ("secret", len(text), len(text) + 40)]


def test_model_finds_disguised_data_and_leaves_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    words = sorted({w for t in texts for w in re.findall("[a-z]{3,8}", t)})[:2000]
    draw = random.Random(11)
    right, true, found = Counter(), Counter(), Counter()
    for _ in range(150):
        text, spans = planted(draw, words)
        added = set(pii.chosen(text, model))
        true.update(k for k, _, _ in spans)
        right.update(k for k, _, _ in added & set(spans))
        found.update(k for k, _, _ in added)
    for kind in pii.ALL_KINDS:
        assert right[kind] >= 0.9 * true[kind], (kind, right, true)
        assert right[kind] >= 0.98 * found[kind], (kind, right, found)
    # In the documents secrets are added, and next to nothing else.
    rows = [(t, pii.chosen(t, model), pii.sure_spans(t)) for t in texts]
    other = sum(len(set(spans) - set(sure)) for _, spans, sure in rows)
    secrets = sum(k == "secret" for _, _, sure in rows for k, _, _ in sure)
    caught = sum(s[0] == "secret" and s in sure for _, spans, sure in rows for s in spans)
    assert secrets > 3 and caught >= 0.9 * secrets and other <= 0.02 * sum(len(spans) for _, spans, _ in rows)
    counted = pii.find_pii(docs, model).agg(F.sum("n_spans")).head()[0]
    assert counted == sum(len(spans) for _, spans, _ in rows)
    text, spans = pii.disguised("write to anna.b@mail7.example.com or call +1 (415) 555-2671 today", pii.base_spans("write to anna.b@mail7.example.com or call +1 (415) 555-2671 today"))
    assert pii.base_spans(text) != spans
    rows = pii.find_pii(frame(spark, odd_rows()).withColumn("spans", F.lit(1)), model)
    assert rows.count() == len(odd_rows()) and rows.where("n_email > 0").count() == 0
    assert pii.fit(frame(spark, odd_rows())) is None


def test_every_document_teaches(spark):
    # The kind of the thresholds below is only in documents that are late by hash,
    # and there only as tokens that have nothing but letters before their digit.
    ids = spark.range(9000).withColumn("tail", F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop"))
    plain = ids.select(F.col("id").alias("doc_id"), F.format_string("mail anna%d@example.com, order 12345678901 of %s", "id", F.substring("tail", 1, 8)).alias("text"))
    late = ids.select((F.col("id") + 9000).alias("doc_id"), F.format_string("token = %s7", F.substring("tail", 1, 20)).alias("text"))
    early = plain.where(F.xxhash64("doc_id", "text") < 0)
    docs = early.union(late.where(F.xxhash64("doc_id", "text") > 0).limit(200))
    assert early.count() > 4000
    model = pii.fit(docs)
    assert model.thresholds["secret"] <= 1
    assert [k for k, _, _ in pii.chosen("token = abcdefghijklmnopqrst7", model)] == ["secret"]
    # Counted examples weigh what repeated ones do.
    again = pii.fit(docs.union(docs))
    assert again.thresholds == pytest.approx(model.thresholds)


def test_upper_case_at_is_proposed():
    every = pii.PiiModel((), dict.fromkeys(pii.KINDS, 0.0), pii.PiiSpec())  # adds all proposals
    for text in ("Kontakt: hans.maier (AT) firma (DOT) de", "HANS.MAIER AT FIRMA DOT DE"):
        spans = pii.chosen(text, every)
        assert [k for k, _, _ in spans] == ["email"] and text[spans[0][1] : spans[0][2]].lower().startswith("hans.maier")


def test_redaction():
    text = "mail a.b@c.de, 10.0.0.1!"
    assert pii.redacted(text, pii.base_spans(text)) == "mail <email>, <ip>!"
    assert pii.redacted(None, []) is None and pii.written(pii.base_spans(text)) == "email:5:13,ip:15:23"


def test_loss_text_is_read_through_the_mask(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "é<s>[INST]" * (i * 13 % 400)) for i in range(40)]
    chats = chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    said = "".join(t for _, i, _, t in rows if i % 2)
    r = chat.digest(chats).head()
    assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["end"] + 1).alias("end")))
    shifted = chat.digest(chats.withColumn("loss_spans", moved)).head()
    assert shifted["turns_sha256"] == r["turns_sha256"] and shifted["loss_sha256"] != r["loss_sha256"]
    edges = frame(spark, [(0, "x" * 5000 + "y" * 4000)], "conv_id long, formatted string").withColumn(
        "loss_spans", F.expr("array(struct(0L as start, 0L as end), struct(4095L as start, 4097L as end), struct(0L as start, 9000L as end), struct(8192L as start, 9000L as end), struct(9000L as start, 9000L as end))")
    )
    text = "x" * 5000 + "y" * 4000
    assert chat.with_learned(edges).head()["learned"] == ["", text[4095:4097], text, text[8192:], ""]


# -- decontamination ----------------------------------------------------------------


def plain_leaks(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(len(w), n)
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if windows and tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_leaks_equal_plain_search(spark):
    items = [(1, "Alpha, beta; gamma"), (2, " ".join(f"w{i}" for i in range(15))), (3, None), (4, "..."), (10, "alpha beta GAMMA"), (5, "é ü")]
    texts = ["x alpha-beta gamma y", " ".join(f"W{i}" for i in range(3, 14)), "alphabeta gamma", "é\nü é ü", "É ü", None, "", "w1 w2", "alpha beta gamma beta gamma"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + odd_rows()
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    for spec in (decontaminate.LeakSpec(), decontaminate.LeakSpec(block_bytes=40)):  # one automaton, and several
        got = rows_of(decontaminate.digest(decontaminate.contamination(docs, bench, spec)))
        assert got == sorted(((r[0], *plain_leaks(r[1], items)) for r in rows), key=str)
    spans = decontaminate.contamination(docs.where("doc_id = 0"), bench).first()["spans"]
    assert [tuple(s) for s in spans] == [(2, 18)]
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# -- pieces ---------------------------------------------------------------------------


def test_pieces_equal_the_library_and_come_back(spark):
    pieces, library = sentencepieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(5)
    texts = [r["text"] for r in table(spark, "documents").select("text").limit(150).collect()]
    texts += ["".join(draw.choice(" \n\tabethinЖ日😀#=-") for _ in range(draw.randint(0, 150))) for _ in range(500)]
    texts += ["a" + " " * n + "b" for n in range(1, 60)] + ["thereinonaction" * 500, "=" * 3000, " ", "\n", "\n a"]
    for text in texts:
        assert pieces.encode(text) == library.encode(text)
    for text in [*texts, "▁ ▁a", *[r[1] or "" for r in odd_rows()]]:
        assert pieces.decode(pieces.encode(text)) == text


def test_search_commits_before_the_end():
    pieces = sentencepieces.Pieces(MODEL)
    committed = list(pieces.search(" thereinonaction" * 100))
    assert len(committed) > 10 and max(map(len, committed)) < 100


def test_pieces_of_odd_rows(spark):
    docs = frame(spark, odd_rows()).withColumn("IDS", F.lit("clash"))
    rows = sentencepieces.digest(docs)
    assert rows.count() == len(odd_rows()) and rows.where("not same_text").count() == 0
    assert sentencepieces.digest(docs.limit(0)).count() == 0


# -- rule ensemble ----------------------------------------------------------------------


def test_ensemble_is_right_on_held_out_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = rule_ensemble.fit(docs, labels)
    rows = rule_ensemble.digest(rule_ensemble.score(docs, model)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right > 0.93 * len(rows) and model.described()
    odd = rule_ensemble.score(frame(spark, odd_rows()).withColumn("score", F.lit("clash")), model)
    assert odd.where("score between 0 and 1").count() == len(odd_rows())
    assert rule_ensemble.fit(docs, labels.where("quality = 1")) is None
    assert rule_ensemble.score(docs.limit(3), None).where("score = 0.5").count() == 3


# -- chats ------------------------------------------------------------------------------


TURNS = "conv_id long, turn long, role string, text string"
ODD_TEXTS = [
    "</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[\\INST]", "[INST", "<", "", None, "a\nb", "\n", "[/INST]</s><s>[INST]user\nx",
    "\\", "<\\", "[<s>", "%0A", "é日😀",
]


def test_chats_come_back(spark):
    rows = [(c, t, role, text) for c, text in enumerate(ODD_TEXTS) for t, role in enumerate(("system", "user", "assistant"))]
    rows += [(100, 1, "assistant", "b"), (100, 0, "we[ir]d\n<s>%0A", "a"), (100, None, None, None), (100, 1, "assistant", "b"), (None, 3, "user", "x")]
    chats = chat.format_chats(frame(spark, rows, TURNS).withColumn("parsed", F.lit(1)))
    got = {r.conv_id: r for r in chats.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [(t.role, t.text) for t in got[conv].parsed] == want and got[conv].n_turns == len(want)
        formatted = got[conv].formatted
        loss = [formatted[s.start : s.end] for s in got[conv].loss_spans]
        safe = [re.sub(r"\[(\\*/?INST\])", r"[\\\1", re.sub(r"<(\\*/?s>)", r"<\\\1", t)) for role, t in want if role == "assistant"]
        assert loss == safe
    assert got[4].formatted.count("<s>") == 3
    assert chat.format_chats(frame(spark, [], TURNS)).count() == 0


def test_chat_plan_is_native(spark):
    plan = chat.digest(chat.format_chats(table(spark, "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["op5_chat_formatting", "op7_benchmark_decontamination"])
def test_registered_query_gives_rows(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
