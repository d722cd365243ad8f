"""Word and shingle hashes of UTF-8 text with numpy, without a Python object per word.

A word's hash is a polynomial over its lower-cased bytes modulo 2**64, taken from prefix sums and
finished with a 64-bit mixer. Texts of any length are read in pieces that end between words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], U))[0])


_powers: dict[str, np.ndarray] = {"up": np.zeros(0, U), "down": np.zeros(0, U)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, b in (("up", BASE), ("down", BASE_INV)):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _piece(b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(max(len(b), PIECE + 1))
    c = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U)), starts


def word_hashes(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    b = LOWER[buf]
    w = is_word[b]
    if len(b) <= 2 * PIECE:
        return _piece(b, w)
    hashes, starts, pos = [], [], 0
    while pos < len(b):
        end = min(pos + PIECE, len(b))
        while end < len(b) and w[end - 1]:
            gap = np.flatnonzero(~w[end : end + PIECE])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + PIECE, len(b))
        h, s = _piece(b[pos:end], w[pos:end])
        hashes.append(h)
        starts.append(s + pos)
        pos = end
    return np.concatenate(hashes), np.concatenate(starts)


def spaced(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts i..j with a blank after each, and where each begins."""
    lens = np.diff(off[i : j + 1])
    begin = np.concatenate(([0], np.cumsum(lens + 1)))
    buf = np.full(int(begin[-1]), 32, np.uint8)
    for k in range(j - i):
        buf[begin[k] : begin[k] + lens[k]] = data[off[i + k] : off[i + k + 1]]
    return buf, begin


def words_by_text(data: np.ndarray, off: np.ndarray, i: int, j: int, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts i..j, and the bounds of each text's words."""
    buf, begin = spaced(data, off, i, j)
    h, starts = word_hashes(buf, is_word)
    return h, np.searchsorted(starts, begin)


SLOT = [U(mix_int(0x5EED + k) | 1) for k in range(64)]


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = np.full(n, U(k), U)
    for t in range(k):
        acc += mix(h[t : t + n] * SLOT[t] + SLOT[-1 - t])
    return mix(acc)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; fewer words make one shingle of the whole sequence."""
    rolled, out = _roll(h, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(_roll(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out
