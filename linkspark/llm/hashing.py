"""Hashes of words, windows and shingles, on numpy arrays.

Arithmetic is modulo the prime 2**61 - 1. A word's hash is the sum of its pieces of four bytes and its length, each
times a factor drawn from the seed; a longer word's is a keyed BLAKE2b. Any two words collide under one seed in 2**61.
A window of words is the polynomial of its words' hashes, as Rabin and Karp take it; the windows of a length come from
those of half the length, so that each step works on all windows of a text at once. Equal windows have equal hashes;
whether equal hashes are equal windows is for the caller to verify, who can take another seed if not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import islice

import numpy as np

PRIME = (1 << 61) - 1
_P, _LOW, _HALF = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61 = np.uint64(31), np.uint64(30), np.uint64(61)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a word that is hashed by pieces.
_SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_32 = np.uint64(32)


def words_of(text: str | bytes | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8: runs without 0x20 and 0x09 to 0x0D. With ``lower``, A to Z become a to z."""
    data = text.encode() if isinstance(text, str) else text or b""
    return (data.translate(_LOWER) if lower else data).split()


def shingles_of(words: Sequence[bytes], length: int) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``length`` words; of fewer words all of them as one, of none no run."""
    if len(words) < length:
        return {tuple(words)} if words else set()
    return set(zip(*(islice(words, k, None) for k in range(length)), strict=False))


class WordHashes:
    """Numbers below PRIME for words, under one seed."""

    def __init__(self, seed: int = 0) -> None:
        self.key = b"words-%d" % seed
        self.base = self._hash(b"base") % (PRIME - 2) + 2
        self.factors = [self._hash(b"factor %d" % k) for k in range(_SHORT // 4 + 1)]

    def _hash(self, data: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=16, key=self.key).digest(), "little") % PRIME

    def of(self, words: list[bytes]) -> np.ndarray:
        """A hash for each word."""
        if not words:
            return np.empty(0, np.uint64)
        data = np.frombuffer(b" ".join(words) + bytes(8), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        eight = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,), writeable=False)
        out = _times(sizes.astype(np.uint64), self.factors[-1])
        for at in range(0, min(int(sizes.max()), _SHORT), 8):
            some = np.flatnonzero((sizes > at) & (sizes <= _SHORT))
            x = eight[starts[some] + at] & _MASKS[np.minimum(sizes[some] - at, 8)]
            k = at // 4
            out[some] = _add(out[some], _add(_times(x & _MASKS[4], self.factors[k]), _times(x >> _32, self.factors[k + 1])))
        for k in np.flatnonzero(sizes > _SHORT).tolist():
            out[k] = self._hash(words[k])
        return out

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        """The hash of each window of ``length`` consecutive words, at the window's first word."""
        if len(words) < length:
            return np.empty(0, np.uint64)
        done, value, size, part = 0, None, 1, words
        while True:  # by the binary digits of the length: value covers ``done`` words, part covers ``size``
            if length & size:
                n = len(words) - done - size + 1
                value = part[:n] if value is None else _add(_times(value[:n], pow(self.base, size, PRIME)), part[done : done + n])
                done += size
            if done == length:
                return mix(value)
            part = _add(_times(part[: len(part) - size], pow(self.base, size, PRIME)), part[size:])
            size *= 2


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduce(a + b)


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo PRIME, by halves of 31 and 30 bits whose products fit 64 bits."""
    high, low = np.uint64(factor >> 31), np.uint64(factor & int(_LOW))
    x_high, x_low = x >> _31, x & _LOW
    middle = x_high * low + x_low * high
    return _reduce(x_high * high * np.uint64(2) + (middle >> _30) + ((middle & _HALF) << _31) + _reduce(x_low * low))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers, the finaliser of splitmix64: spreads numbers evenly over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _30
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> _31
    return x
