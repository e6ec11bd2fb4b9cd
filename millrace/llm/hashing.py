"""Hashes of words over whole batches of texts at once.

All texts of a slice are laid end to end in one byte array; words are found by a mask and hashed
together, so there is no Python step for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Byte maps: A to Z to lower case, everything else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 1 where a byte belongs to a word, for words between ASCII white space.
BETWEEN_SPACES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256)], bool)
#: 1 where a byte belongs to a word of letters, digits and all of non-ASCII.
ALPHANUMERIC = np.array([b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)], bool)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over 64 output bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """1, f, f^2, ... modulo 2^64."""
    out = np.full(n, _FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """hashes: of all words in order; first: for each text, where its words begin (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of `size` words within a text, and for each text where its runs begin."""
        n = len(self.hashes)
        counts = np.maximum(np.diff(self.first) - (size - 1), 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if n < size or not first[-1]:
            return np.zeros(0, np.uint64), first
        runs = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            runs = runs * _FACTOR + self.hashes[k : n - size + 1 + k]
        runs = mix(runs)
        at = np.repeat(self.first[:-1] - first[:-1], counts) + np.arange(first[-1])
        return runs[at], first


#: Bytes of a UTF-8 character by its first byte, for characters that are words of their own: kana, Han and all of four bytes.
_WIDE = np.array([3 if 0xE3 <= b <= 0xE9 else 4 if 0xF0 <= b <= 0xF4 else 0 for b in range(256)], np.int64)


def _borders(data: np.ndarray) -> np.ndarray:
    """True where a character of a script without spaces begins or has just ended."""
    out = np.zeros(len(data) + 4, bool)
    at = np.flatnonzero(_WIDE[data])
    out[at] = True
    out[at + _WIDE[data[at]]] = True
    return out[: len(data)]


def hash_words(texts: list[bytes | None], inside: np.ndarray = BETWEEN_SPACES, single: bool = False) -> Words:
    """The words of every text; A to Z count as lower case. A null text has none.

    single: characters of scripts that are written without spaces are words of their own.
    """
    lowered = [(t or b"").translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    text_begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    word = inside[data]
    word[text_begin[1:] - 1] = False
    fresh, gone = np.concatenate([[True], ~word[:-1]]), np.concatenate([~word[1:], [True]])
    if single:
        border = _borders(data)
        fresh |= border
        gone[:-1] |= border[1:]
    begin, end = np.flatnonzero(word & fresh), np.flatnonzero(word & gone) + 1
    first = np.searchsorted(begin, text_begin)
    if not len(begin):
        return Words(np.zeros(0, np.uint64), first)
    size = end - begin
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.concatenate([[0], begin[1:], [len(data)]])))
    np.clip(place, 0, int(size.max()) - 1, out=place)
    values = _BYTE[data] * powers(int(size.max()))[place]
    values[~word] = 0
    sums = np.add.reduceat(values, begin)
    return Words(mix(sums + size.astype(np.uint64)), first)
