"""Hashes of the words of a text with NumPy, without a Python object per word."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed in pieces of about this many code points, cut between words.
PIECE = 1 << 20

_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverse
    if len(_powers) <= n:
        n = max(n + 1, 2 * len(_powers))
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
            table = np.full(n, base, _U)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_space(points: np.ndarray) -> np.ndarray:
    """Space and U+0009 to U+000D."""
    return (points == 32) | ((points >= 9) & (points <= 13))


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, _U)
    _tables(len(points))
    sums = np.zeros(len(points) + 1, _U)
    np.cumsum(mix(points.astype(_U) + _U(1)) * _powers[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(_U))


def _pieces(points: np.ndarray, space: np.ndarray):
    """Bounds of pieces of long texts, cut at spaces where there is one."""
    at = 0
    while len(points) - at > 2 * PIECE:
        cut = np.flatnonzero(space[at + PIECE :])
        if not len(cut):
            break
        end = at + PIECE + int(cut[0])
        yield at, end
        at = end
    yield at, len(points)


def run_hashes(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the maximal runs of code points that are inside, in order."""
    hashes, begins = [], []
    for a, b in _pieces(points, ~inside):
        starts, ends = spans(inside[a:b])
        hashes.append(span_hashes(points[a:b], starts, ends))
        begins.append(starts + a)
    return (hashes[0], begins[0]) if len(hashes) == 1 else (np.concatenate(hashes), np.concatenate(begins))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the runs without white space, in order; null has none."""
    if not text:
        return np.zeros(0, _U)
    points = code_points(text)
    return run_hashes(points, ~is_space(points))[0]


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words, of all words together if they are fewer; none if no word."""
    if not len(words):
        return words
    m = min(n, len(words))
    out = np.full(len(words) - m + 1, m, _U)
    for k in range(m):
        out = mix(out * _U(0xD6E8FEB86659FD93) + words[k : len(words) - m + 1 + k])
    return out
