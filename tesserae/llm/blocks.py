"""Numpy helpers for blocks of texts: bytes, words and hashes of words, without a loop over words.

A block is the texts of an Arrow column as one byte array and the places where each text starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    found = []
    for b in (base, pow(base, -1, 1 << 64)):
        if len(_powers.get((base, b), ())) < n:
            p = np.full(max(n, BLOCK_BYTES + 1), b, np.uint64)
            p[0] = 1
            _powers[base, b] = np.cumprod(p, dtype=np.uint64)
        found.append(_powers[base, b])
    return found[0], found[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its texts. Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold ``most`` bytes at most, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (n + 1 numbers)."""
    inside = ~SPACE_BYTE[data]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[begins] = inside[begins]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    end[lasts] = inside[lasts]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (data: already lower-cased if case is not to count)."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, and their count before each text. A text of
    fewer words has one shingle, its whole sequence; one without words has none."""
    n = np.diff(before)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], np.uint64)
    if len(hashes) >= width:
        run = np.zeros(len(hashes) - width + 1, np.uint64)
        for k in range(width):
            run = run * _BASE + hashes[k : len(hashes) - width + 1 + k]
        run = mix(run)
        long = n >= width
        first = np.repeat(before[:-1][long] - at[:-1][long], counts[long])
        place = np.flatnonzero(np.repeat(long, counts))
        out[place] = run[place + first]
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for x in hashes[before[i] : before[i + 1]]:
                h = h * _BASE + x
        out[at[i]] = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    return out, at
