"""Word splitting and hashing shared by the operators that run in Arrow batches."""

from __future__ import annotations

import re

import numpy as np

LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
# Between space-like ASCII characters, and between all ASCII characters that are no letter or digit.
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str) -> str:
    """A-Z to a-z, nothing else: one call for ASCII texts, a table for others."""
    return text.lower() if text.isascii() else text.translate(LOWER)


# Letters and digits of ASCII with A-Z as a-z and the bytes of all other characters stay; the rest becomes a blank.
PLAIN_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    """The words of ``PLAIN`` in the ASCII-lower-cased text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(PLAIN_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_random = np.random.default_rng(20_011)
# One random number per byte, that of A-Z the same as of a-z.
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
BYTE[65:91] = BYTE[97:123]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
# Odd numbers that weigh the places of a run of words.
PLACE = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < size:
        n = 1 << max(16, size.bit_length())
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _powers[0][:size], _powers[1][:size]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between space-like characters, with A-Z as a-z.

    A word's hash is the sum of its bytes' random numbers times powers of an odd base; all come from one running sum over the text.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    first, last = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``k`` words (at most 64); fewer words make one run, none make an empty set."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out += hashes[i : n - size + 1 + i] * PLACE[i]
    return np.unique(mix(out))
