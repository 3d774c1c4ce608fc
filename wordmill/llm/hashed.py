"""Words and n-grams of whole texts as 64-bit hashes, computed on Arrow buffers inside Spark tasks.

A column of texts is cut into runs of rows of about ``CHUNK`` bytes (a longer row is a run of its own), so the
memory of a task follows the longest text and not the batch. Word hashes are polynomials of the bytes modulo
2**64, taken from one running sum, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: white space only, or everything but ASCII letters, digits and bytes of other characters.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False
PUNCT[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(18, int(n).bit_length()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(texts: pa.Array, chunk: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and offsets of each run of rows."""
    data, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch of bytes."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte of every word; ASCII capitals count as small."""
    inside = ~apart[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return stretches(LOWER[data], start, end), np.searchsorted(offsets, start, "right") - 1, start, end


def grams(hashes: np.ndarray, rows: np.ndarray, steps: tuple[int, ...], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every combination of words at the given distances within one row."""
    n = len(hashes) - steps[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[steps[-1] :])
    out = np.full(len(at), np.uint64(seed))
    for step in steps:
        out = (out + hashes[at + step]) * BASE
        out ^= out >> np.uint64(29)
    return mix(out), rows[at], at


def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key of each row once, by row and key."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]
