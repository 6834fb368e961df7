"""SentencePiece encoding and decoding with a streaming Viterbi search.

The trellis has one state for each boundary in the text: the piece that ends
there on the best path. A piece may follow another only if byte-pair merging of
the two gives these two back; a sequence all of whose neighbours satisfy that is
exactly what merging the whole text gives. Boundaries older than the longest
piece can't start a new piece, so the search keeps that window and the
backpointers that lead into it, and commits ids as soon as all of them pass
through one boundary. No piece reaches over the border before a space or at a line
end, so all paths meet there at the latest; what stands between two such borders
is searched once while it is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import with_text_columns

SPACE = "▁"
#: A run of spaces with what follows. No piece reaches over the border of two
#: such parts, nor over a line end (see ``Pieces``).
PART = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class EncodeSpec:
    """``model_file``: path of a SentencePiece BPE model with byte fallback;
    the file is sent to the executors. ``remembered`` bounds the parts whose
    ids a task keeps, ``remember_up_to`` their length, ``beginnings`` the
    beginnings of parts from which a search can go on."""

    model_file: str = "/opt/tokenizers/piece_bpe_32k.model"
    remembered: int = 200_000
    remember_up_to: int = 48
    beginnings: int = 600_000
    commit_every: int = 64


class Pieces:
    """The vocabulary of a model, and the search over it."""

    def __init__(self, model_file: str, spec: EncodeSpec = EncodeSpec()):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.spec = spec
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [
            i for i in range(len(self.names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {self.names[i].replace(SPACE, " "): i for i in plain}
        self.scores = {self.names[i].replace(SPACE, " "): model.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if any("\n" in p or " " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece reaches over a space or line end")
        self.longest = max(map(len, self.ids))
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.line_end = self.bytes[10]
        #: Ids of recent words, after a space and not, and of those before them: what is in use stays.
        self.recent: tuple[dict, dict] = ({}, {})
        self.older: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        #: Ranks by score (0 merges first). Pieces of spaces only share one score, so they have none.
        order = sorted((p for p in self.ids if len(p) > 1 and p.strip(" ")), key=lambda p: -self.scores[p])
        self.ranks = {p: n for n, p in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        #: Finds the pieces that merging can reach.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: Ends of pieces, with the id of those that merging can reach, and the last piece of short beginnings.
        self.ends: dict[str, int] = {p[i:]: -1 for p in self.ids for i in range(len(p))}
        self.ends |= {p: i for p, i in self.ids.items() if p in self.automaton}
        self.beginnings: dict[str, int] = {}
        self.size = len(self.names)
        self.widths = [len(n) for n in self.names]
        self.raw = [n.replace(SPACE, " ").encode() for n in self.names]
        for i, b in self.of_byte.items():
            self.raw[i] = bytes([b])
        self.is_byte = np.isin(np.arange(self.size), list(self.of_byte))

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored pair first, the
        leftmost of equals. Used for single pieces and pairs."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge makes this one."""
        found = self.halves.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.halves[piece] = (parts[0], parts[1])
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Whether merging keeps the two apart: undoes their merges from the
        last, and asks each time if the facing parts would have met before."""
        ranks = self.ranks
        limit = len(ranks)
        while True:
            if ranks.get(left + right, limit) < limit:
                return False
            a, b = ranks.get(left, -1), ranks.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self._halves(left)[1]
            else:
                limit, right = b + 1, self._halves(right)[0]

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging keeps the two apart; remembered in ``pairs``."""
        if len(self.pairs) >= self.spec.remembered:
            self.pairs.clear()
        a, b = (self.names[i].replace(SPACE, " ") for i in (left, right))
        if all(len(p) == 1 or p in self.ranks for p in (a, b)) and not (a == " " and b[0] == " "):
            found = self._apart(a, b)
        else:
            found = self.merged(a + b) == [a, b]
        self.pairs[left * self.size + right] = found
        return found

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids on the best path, committed while the text is read. An automaton
        names the pieces that end at each boundary."""
        last: dict[int, int] = {}  # boundary: the piece that ends there, or -1 for an unknown character
        pairs, size, widths = self.pairs, self.size, self.widths
        done, check, n, at = 0, self.spec.commit_every, len(text), 0
        for end, piece in self.automaton.iter(text):
            end += 1
            if end != at:
                for unknown in range(at + 1, end):
                    last[unknown] = -1
                at = end
                if end > check:
                    check = end + self.spec.commit_every
                    meet = self._meeting(last, done, end - 1)
                    if meet > done:
                        yield self._path(text, last, done, meet)
                        last = {b: p for b, p in last.items() if b >= meet}
                        done = meet
            elif end in last:
                continue
            start = end - widths[piece]
            if start < done:
                continue
            if start and (left := last.get(start, -1)) >= 0:
                follows = pairs.get(left * size + piece)
                if not (self._follows(left, piece) if follows is None else follows):
                    continue
            last[end] = piece
        for unknown in range(at + 1, n + 1):
            last[unknown] = -1
        yield self._path(text, last, done, n)

    def _path(self, text: str, last: dict[int, int], done: int, end: int) -> list[int]:
        """The ids between two boundaries, followed back from the later one."""
        path: list[int] = []
        while end > done:
            piece = last[end]
            if piece < 0:
                path += [self.bytes[b] for b in reversed(text[end - 1].encode("utf-8", "surrogatepass"))]
                end -= 1
            else:
                path.append(piece)
                end -= self.widths[piece]
        path.reverse()
        return path

    def _meeting(self, last: dict[int, int], done: int, end: int) -> int:
        """The last boundary through which all paths that can go on lead."""
        alive = {b for b in range(max(done, end - self.longest) + 1, end + 1) if b in last}
        while len(alive) > 1:
            far = max(alive)
            alive.discard(far)
            alive.add(far - (1 if last[far] < 0 else self.widths[last[far]]))
        return alive.pop() if alive else done

    def _short(self, text: str) -> tuple[int, ...]:
        """Ids of a short part. The piece that ends a beginning is the same for
        all parts that begin so, and remembered; the search goes on from the
        longest known beginning."""
        known, ends, pairs, size, widths = self.beginnings, self.ends, self.pairs, self.size, self.widths
        if len(known) >= self.spec.beginnings:
            known.clear()
        n = at = len(text)
        while at and text[:at] not in known:
            at -= 1
        for end in range(at + 1, n + 1):
            best = -1
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                piece = ends.get(text[start:end])
                if piece is None:  # nothing longer is a piece either; unknown characters stand alone
                    break
                if piece >= 0:
                    if not start or (left := known[text[:start]]) < 0:
                        best = piece
                        break
                    follows = pairs.get(left * size + piece)
                    if self._follows(left, piece) if follows is None else follows:
                        best = piece
                        break
            known[text[:end]] = best
        path: list[int] = []
        while n:
            piece = known[text[:n]]
            if piece < 0:
                path += [self.bytes[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
                n -= 1
            else:
                path.append(piece)
                n -= widths[piece]
        return tuple(reversed(path))

    def _word(self, word: str, bare: bool) -> tuple[int, ...]:
        """Ids of a word that is not among the recent ones."""
        ids = self.older[bare].get(word)
        if ids is None:
            text = word if bare else " " + word
            ids = self._short(text) if len(text) <= self.spec.commit_every else tuple(i for path in self.search(text) for i in path)
        if len(word) <= self.spec.remember_up_to:
            if len(self.recent[0]) + len(self.recent[1]) >= self.spec.remembered:
                self.older, self.recent = self.recent, ({}, {})
            self.recent[bare][word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts.

        The character that stands for a space inside pieces goes by bytes, so
        every text comes back unchanged.
        """
        if not text:
            return []
        out: list[int] = []
        bare = False  # the first line has a space put before it
        for line in text.split("\n"):
            if bare:
                out.append(self.line_end)
            words = line.split(" ")
            if "" in words:
                for part in PART.findall(line if bare else " " + line):
                    out += self._word(part, True)
            else:
                for word in words:
                    ids = self.recent[bare].get(word)
                    out += self._word(word, bare) if ids is None else ids
                    bare = False
            bare = True
        return out

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding put first is taken off."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def _pieces(df: DataFrame, spec: EncodeSpec):
    """A function for tasks that loads the model; the driver sends the file."""
    name = spec.model_file.rsplit("/", 1)[-1]
    df.sparkSession.sparkContext.addFile(spec.model_file)

    def load() -> Pieces:
        if spec not in _loaded:
            _loaded[spec] = Pieces(SparkFiles.get(name), spec)
        return _loaded[spec]

    return load


#: Models that this Python process has read; what they remember serves its next tasks.
_loaded: dict[EncodeSpec, Pieces] = {}


def encode(docs: DataFrame, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """The rows of ``docs`` with ``ids`` (array of int), ``n_ids`` and ``n_byte_ids``.

    Null and empty texts have no ids. Columns of the same names are replaced.
    """
    load = _pieces(docs, spec)

    def setup():
        pieces = load()

        def of(text):
            ids = np.array(pieces.encode(text), np.int32)
            return ids, len(ids), int(pieces.is_byte[ids].sum())

        return of

    return with_text_columns(docs, "ids array<int>, n_ids long, n_byte_ids long", setup)


def decode(encoded: DataFrame, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``; null ids give the empty text."""
    load = _pieces(encoded, spec)

    def setup():
        pieces = load()
        return lambda ids: (pieces.decode(ids),)

    def numbers(ids: pa.ListScalar) -> list[int]:
        return ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []

    return with_text_columns(encoded, "decoded string", setup, text="ids", read=numbers)


def coded(docs: DataFrame, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """What ``encode`` and then ``decode`` add, in one pass over the texts."""
    load = _pieces(docs, spec)

    def setup():
        pieces = load()

        def of(text):
            listed = pieces.encode(text)
            ids = np.array(listed, np.int32)
            return ids, len(ids), int(pieces.is_byte[ids].sum()), pieces.decode(listed)

        return of

    return with_text_columns(docs, "ids array<int>, n_ids long, n_byte_ids long, decoded string", setup)


def digest(docs: DataFrame, spec: EncodeSpec = EncodeSpec()) -> DataFrame:
    """doc_id, counts, the digest of the ids (joined by commas) and of the text
    that decoding gives back, and whether that is the text itself."""
    out = coded(docs, spec)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        "n_ids",
        "n_byte_ids",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == text).alias("same_text"),
    )
