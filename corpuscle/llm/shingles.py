"""Hashes of word shingles, computed over the bytes of a whole text at once."""

from __future__ import annotations


import numpy as np

_ALNUM = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
#: Lower case for A-Z, a blank for every other ASCII character that is no digit or letter.
FOLD = bytes(ord(chr(b).lower()) if b < 128 and b in _ALNUM else b if b in _ALNUM else 32 for b in range(256))

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII digits and letters, lower-cased, and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = 1 << max(17, n.bit_length())
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word, in order: differences of a running polynomial, moved to place 0."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(FOLD), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b != 32
    edge = np.flatnonzero(np.diff(inside))
    start, stop = edge[::2], edge[1::2]
    up, down = _grown(len(b))
    running = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[: len(b)], out=running[1:])
    return _mixed((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(_BASE) + words[k : k + n]
    return _mixed(h)


def shingle_set(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves; a shorter text is one shingle, a text without words has none."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size)), strict=False))


