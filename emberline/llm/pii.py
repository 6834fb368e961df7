"""Personal data: generators propose spans, boosted trees choose among them.

Strict patterns give the base spans, which always stay. Loose patterns propose
further, overlapping spans, tokens that may be secrets among them; boosted trees
judge each by its format and context. They learn from the base spans of the
corpus, as they are and rewritten in the ways people disguise such data, and from
tokens assigned to a telling name, against all other proposals. For each kind the
threshold is calibrated on held-out documents so that what is added is precise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import with_text_columns
from emberline.llm.trees import plain_trees, value
from emberline.sources.writers import stored

#: Kinds with base spans, in the order in which spans are listed; the last kind has proposals only.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\bat\b", re.IGNORECASE)


@dataclass(frozen=True)
class PiiSpec:
    """Nothing bounds the documents of the fit."""

    trees: int = 20
    depth: int = 4
    precision: float = 0.98
    context: int = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """One look at each ``@``: the name before it, then the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", end if found else at + 1)


def _ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts), 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str | None) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, kinds as listed."""
    if not text:
        return []
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


#: Loose patterns; bounded repetitions keep them linear, and possessive ones
#: don't go back where what follows can't begin any earlier.
_LOOSE = (
    (
        "email",
        re.compile(
            r"(?<![\w.+-])[\w.+-]{1,64}+\s?(?:@|[\[(]\s?at\s?[\])]|\sat\s)\s?[\w-]{1,64}+"
            r"(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[\w-]{2,24}){1,4}",
            re.IGNORECASE,
        ),
    ),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|[.,:])\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ .\-/]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:(?:\+|00)\s?)?\(?[0-9](?:[ ().\-/]{0,3}[0-9]){7,14}(?![0-9])")),
    ("secret", re.compile(r"(?<![\w+/=-])(?=[A-Za-z_+/=-]{0,64}+[0-9])[A-Za-z0-9_+/=-]{16,256}(?![\w+/=-])")),
)
#: What is assigned to a name that says it is secret; these teach the trees.
_ASSIGNED = re.compile(
    r"\b(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d)\b\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{16,256})(?![\w+/=-])", re.IGNORECASE
)


def sure_spans(text: str) -> list[Span]:
    """Base spans, and tokens that are assigned to a telling name."""
    return [*base_spans(text), *(("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text) if re.search("[0-9]", m.group(1)))]


def proposals(text: str) -> list[Span]:
    found = [(kind, m.start(), m.end()) for kind, pattern in _LOOSE for m in pattern.finditer(text)]
    return list(dict.fromkeys([*base_spans(text), *found]))


FEATURES = (
    *ALL_KINDS, "chars", "digits", "separators", "kinds_of_separator", "groups", "longest_group", "shortest_group", "plus",
    "brackets", "at_sign", "at_word", "dots", "luhn", "parts_fit", "letter_before", "letter_behind", "mark_before",
    "mark_behind", "hint_email", "hint_ip", "hint_card", "hint_phone", "hint_secret", "digits_around", "letters_last",
    "letters", "changes",
)

_HINTS = (
    re.compile(r"mail|contact|write|reach", re.IGNORECASE),
    re.compile(r"\bip|host|addr|server|from", re.IGNORECASE),
    re.compile(r"card|visa|credit|pay", re.IGNORECASE),
    re.compile(r"tel|phone|call|fax|mobil", re.IGNORECASE),
    re.compile(r"token|secret|key|passw|auth", re.IGNORECASE),
)
_GROUP = re.compile(r"[0-9]+")


def features(text: str, span: Span, width: int) -> list[float]:
    kind, start, end = span
    own, before, behind = text[start:end], text[max(0, start - width) : start], text[end : end + width]
    groups = [len(g) for g in _GROUP.findall(own)] or [0]
    digits = _digits(own)
    apart = [c for c in own if not c.isalnum()]
    parts = _GROUP.findall(own)
    return [
        *(float(kind == k) for k in ALL_KINDS),
        float(len(own)),
        float(len(digits)),
        float(len(apart)),
        float(len(set(apart))),
        float(len(groups)),
        float(max(groups)),
        float(min(groups)),
        float(own[:1] == "+"),
        float("(" in own or "[" in own),
        float("@" in own),
        float(bool(re.search(r"\bat\b", own, re.IGNORECASE))),
        float(own.count(".") + len(re.findall(r"\bdot\b", own, re.IGNORECASE))),
        float(len(digits) >= 13 and luhn(digits)),
        float(len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(before[-1:].isalnum()),
        float(behind[:1].isalnum()),
        float(before[-1:] in tuple("=\"'/#$_")),
        float(behind[:1] in tuple("=\"'/#$_")),
        *(float(bool(h.search(before))) for h in _HINTS),
        float(len(_digits(before + behind))),
        float(len(own) - len(own.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))),
        float(sum(c.isalpha() for c in own)),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:]))),
    ]


def disguised(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with its spans rewritten, and where they are then. Which way is
    drawn from the span itself; secrets stay as they are."""
    out, moved, at = [], [], 0
    size = 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start < at:
            continue
        own = text[start:end]
        way = zlib.crc32(own.encode("utf-8", "surrogatepass")) % 3
        if kind == "email":
            name, domain = own.rsplit("@", 1)
            at_word, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))[way]
            own = name + at_word + domain.replace(".", dot)
        elif kind == "ip":
            own = own.replace(".", ("[.]", " . ", "(.)")[way])
        elif kind == "card":
            digits = _digits(own)
            own = (".", "/", "  ")[way].join(digits[i : i + 4] for i in range(0, len(digits), 4))
        elif kind == "phone":
            own = ("00" + own[1:], own[1:].strip(), own.replace(" ", "/"))[way]
        out += [text[at:start], own]
        size += start - at
        moved.append((kind, size, size + len(own)))
        size += len(own)
        at = end
    return "".join([*out, text[at:]]), moved


def _mask(text: str, spans: list[Span]) -> bytearray:
    """1 for each character that a span covers."""
    mask = bytearray(len(text))
    for _, start, end in spans:
        mask[start:end] = b"\x01" * (end - start)
    return mask


def examples(text: str | None, width: int) -> list[tuple[float, list[float]]]:
    """(label, features) of the proposals in a text and in its disguised form."""
    if not text or not _ANY.search(text):
        return []
    out = []
    sure = sure_spans(text)
    for body, true in ((text, sure), *([disguised(text, sure)] if sure else [])):
        held = {(k, s): e for k, s, e in true}
        covers = {kind: _mask(body, [s for s in true if s[0] == kind]) for kind in ALL_KINDS}
        for span in proposals(body):
            kind, start, end = span
            label = held.get((kind, start)) == end
            if label or not any(covers[kind][start:end]):  # a part of a true span teaches nothing
                out.append((float(label), features(body, span, width)))
    return out


@dataclass(frozen=True)
class PiiModel:
    """Trees with their weights, and the least probability for each kind."""

    trees: tuple
    thresholds: dict[str, float]
    spec: PiiSpec

    def probability(self, row: list[float]) -> float:
        margin = sum(w * value(t, row) for w, t in self.trees)
        return float(1 / (1 + np.exp(-2 * np.clip(margin, -250, 250))))


def fit(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> PiiModel | None:
    """None if the documents have no base span, or nothing else.

    All documents teach or, one in four, calibrate. Equal examples are counted,
    and the trees take the counts as weights.
    """

    def setup():
        def of(text):
            found = examples(text, spec.context)
            return [label for label, _ in found], [row for _, row in found]

        return of

    found = with_text_columns(docs.select("doc_id", "text"), "label array<double>, row array<array<double>>", setup)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    found = found.select((part > 0).alias("learn"), F.explode(F.arrays_zip("label", "row")).alias("e"))
    rows = found.groupBy("learn", "e.label", "e.row").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = stored(rows.sortWithinPartitions("learn", "label", "row"), "pii_examples")
    learn = rows.where("learn").select("label", "n", array_to_vector("row").alias("features"))
    if learn.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=spec.trees, maxDepth=spec.depth, stepSize=0.2, seed=5, weightCol="n").fit(learn)
    fitted = PiiModel(tuple(plain_trees(model)), {}, spec)
    # The held-out part, counted by kind and score: at most ten thousand rows a kind.
    held = with_text_columns(
        rows.where("not learn").select("label", "row", "n"), "score double", lambda: lambda row: (round(fitted.probability(row), 4),), text="row"
    )
    kind = F.array_position(F.slice("row", 1, len(ALL_KINDS)), 1.0).alias("kind")
    counts = held.groupBy(kind, "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()
    thresholds = {
        name: calibrated([(r["score"], r["n"], r["right"]) for r in counts if r["kind"] == i], spec.precision)
        for i, name in enumerate(ALL_KINDS, 1)
    }
    return PiiModel(fitted.trees, thresholds, spec)


def calibrated(scores: list[tuple[float, float, float]], precision: float) -> float:
    """Of (score, rows, rows that are right): the threshold from which on the
    wanted share is right, halfway to the next score below, at least a half;
    above every score if there is none."""
    best, right, rows = 2.0, 0.0, 0
    ordered = sorted(scores, reverse=True)
    for i, (score, n, good) in enumerate(ordered):
        right, rows = right + good, rows + n
        if right >= precision * rows and score >= 0.5:
            below = ordered[i + 1][0] if i + 1 < len(ordered) else 0.0
            best = max(0.5, (score + below) / 2)
    return best


def chosen(text: str | None, model: PiiModel | None) -> list[Span]:
    """Base spans and what the model adds. What is added overlaps no base span;
    of overlapping additions the likelier stays, then the longer, then the first."""
    base = base_spans(text)
    if model is None or not text or not _ANY.search(text):
        return base
    taken = _mask(text, base)
    scored = []
    for span in proposals(text):
        _, start, end = span
        if any(taken[start:end]):
            continue
        p = model.probability(features(text, span, model.spec.context))
        if p >= model.thresholds.get(span[0], 2.0):
            scored.append((-p, start - end, start, span))
    added: list[Span] = []
    for _, _, _, span in sorted(scored):
        if not any(taken[span[1] : span[2]]):
            taken[span[1] : span[2]] = b"\x01" * (span[2] - span[1])
            added.append(span)
    return sorted([*base, *added], key=lambda s: (ALL_KINDS.index(s[0]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are one."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """The rows of ``docs`` with n_email, n_ip, n_card and n_phone (base
    spans), ``n_spans`` (all), ``base_spans``, ``spans`` (all) and ``redacted``.

    Null and empty texts have no spans; null stays null when redacted. Rows are
    read one by one, so repeated rows and ids don't matter; columns of the same
    names are replaced. Without a model only base spans are found.
    """

    def setup():
        def of(text):
            base = base_spans(text)
            spans = chosen(text, model)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            return *counts, len(spans), written(base), written(spans), redacted(text, spans)

        return of

    return with_text_columns(
        docs, "n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_spans string, spans string, redacted string", setup
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans", F.sha2("redacted", 256).alias("redacted_sha256")
    )
