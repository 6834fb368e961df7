"""Words, lines and hashes of one text as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the hashes; any odd numbers would do.
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse, modulo 2^64."""
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 4096), BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits (one to one)."""
    h = h.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)


def word_bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space (U+0020, U+0009 to U+000D)."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of one running sum."""
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power("up", len(points)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", len(points) + 1)[starts]
    return mixed(h + np.uint64(STEP) * (ends - starts).astype(np.uint64))


def word_hashes(points: np.ndarray) -> np.ndarray:
    return span_hashes(points, *word_bounds(points))


def run_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive items; none if there are fewer."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    size = len(items) - n + 1
    h = items[:size].copy()
    for k in range(1, n):
        h = h * np.uint64(STEP) + items[k : k + size]
    return mixed(h)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of n lower-cased words; a text of
    fewer words has its whole sequence as one, one without words none."""
    if not text:
        return np.zeros(0, np.uint64)
    words = word_hashes(lower_ascii(code_points(text)))
    if not len(words):
        return words
    if len(words) < n:
        return run_hashes(np.concatenate([np.full(1, len(words), np.uint64), words]), len(words) + 1)
    return np.unique(run_hashes(words, n))
