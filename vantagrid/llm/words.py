"""Words and word shingles of whole texts, as arrays over the bytes of a batch.

A word is ``[^\\x20\\x09-\\x0D]+``.  A batch of texts is one run of UTF-8 bytes;
every word gets a 64-bit hash from prefix sums over those bytes, so no Python
object is made for a word.  ``pieces`` cuts a batch so that the arrays at
hand stay near ``CHUNK_BYTES`` bytes of text, or one text where it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        values[65:91] = values[97:123]
    return values


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of a run of texts: ``first[i]:first[i + 1]`` are those of text i."""

    start: np.ndarray  # byte where a word starts, in the run
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def separators(plain: str) -> np.ndarray:
    """A table of bytes that part words: every ASCII sign outside of ``plain``."""
    table = np.arange(256) < 128
    table[[ord(c) for c in plain]] = False
    return table


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, separator: np.ndarray = _SEPARATOR) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    inside = ~separator[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[:n], out=sums[1:])
    return Words(start, end, mix((sums[end] - sums[start]) * down[start]), np.searchsorted(start, offsets))


@lru_cache(maxsize=8)
def _places(k: int) -> np.ndarray:
    return mix(np.arange(11, 11 + k, dtype=np.uint64) * _BASE) | np.uint64(1)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive entries, over text borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i, c in enumerate(_places(k)):
        total += hashes[i : i + n] * c
    return mix(total)


def shingles(words: Words, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct shingles of ``k`` words.

    A text of fewer words has one shingle, the whole sequence; one without
    words has none.
    """
    every = runs(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            whole = (words.hash[a:b] * _places(k)[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, lower: bool, chunk: int = CHUNK_BYTES, separator: np.ndarray = _SEPARATOR) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(from row, to row, bytes, offsets, words) for runs of rows of about ``chunk`` bytes."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + chunk, side="right")) - 1)
        run, offsets = data[at[i] : at[j]], at[i : j + 1] - at[i]
        yield i, j, run, offsets, words_of(run, offsets, lower, separator)
        i = j
