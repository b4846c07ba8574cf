"""Vectorised word scanning over UTF-8 bytes (numpy inside Spark's Arrow steps)."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


_POW: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))
_BYTE = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * _BASE))

#: Words of the decontamination contract: ASCII letters (lower-cased) and digits, and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words between the six ASCII blanks.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False


def spans(buf: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are members."""
    edge = np.diff(np.concatenate(([0], member[buf].view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: a polynomial over its bytes, from prefix sums block by block, then mixed."""
    global _POW
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _BLOCK, side="right")))
        b = ends[j - 1]
        if b - a > len(_POW[0]):
            _POW = _powers(int(max(b - a, _BLOCK)))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf[a:b]] * _POW[0][:b - a])))
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = _mixed((total[e] - total[s]) * _POW[1][s])
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every ``n`` consecutive words, from their hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(m, np.uint64(n), np.uint64)
        for k in range(n):
            acc = acc * _BASE + words[k:k + m]
        return _mixed(acc)


def joined(texts: list) -> tuple[bytes, np.ndarray]:
    """The texts (bytes or None), each followed by a line end, and where each begins; one offset more than texts."""
    parts = [t or b"" for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in parts]))).astype(np.int64)
    return b"\n".join(parts) + b"\n", offsets
