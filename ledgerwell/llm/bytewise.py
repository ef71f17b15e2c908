"""Hashing of words and byte windows, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(73)
#: A random 64-bit value for each byte, and the odd base of the rolling polynomial with its inverse modulo 2**64.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes of text worked on at once.
CHUNK = 1 << 21

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2**64; kept, and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        full = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * BASE ** place, from which the hash of any stretch follows."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows, null as empty, without copying the text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) with about `most` bytes each, a longer text alone, with their bytes and offsets."""
    raw, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and of each row the number of its first word (one more at the end)."""
    inside = np.concatenate([[False], ~SPACES[raw], [False]])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begins = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    joined = cut[inside[cut] & inside[cut + 1]]  # a word that runs on into the next row is two
    begins[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct hashes of its word shingles, A-Z as lower case; a shorter text is one shingle."""
    weight = [np.uint64(int(BYTE[k]) | 1) for k in range(size)]
    for _, _, raw, offsets in chunks(column):
        sums = prefix(BYTE[LOWER[raw]])
        start, end, first = word_bounds(raw, offsets)
        word = mix(stretch(sums, start, end))
        n = len(word)
        total = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            total += word[k : k + len(total)] * weight[k]
        total = mix(total)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(total[a : b - size + 1])
            elif b > a:
                yield mix((word[a:b] * np.array(weight[: b - a], np.uint64)).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
