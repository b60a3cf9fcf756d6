"""Words of texts as numpy arrays: one pass over the UTF-8 bytes of an Arrow column, whole texts, no Python loop per word.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a 64-bit polynomial of its bytes; two texts of equal
words have equal hashes in every process and session.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
"""Texts are worked on in groups of about this many bytes, so that the arrays stay small; a longer text is its own group."""

KEPT_POWERS = 1 << 21
"""A longer table of powers is made for its text alone."""
_BASE = 0x9E3779B97F4A7C15 | 3
_WORD_BASE = 0xD6E8FEB86659FD93 | 3
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_LETTERS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (at least)."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 2**64)
        known = tuple(
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (base, inverse)
        )
        if size <= KEPT_POWERS:
            _powers[base] = known
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts of about ``limit`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of consecutive texts: hashes, byte ranges in ``data``, and per text the range of its words in ``bounds``."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]. lower: A-Z count as a-z in the hashes and in ``data``."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    cuts = offsets - base
    if lower:
        data = LOWER[data]
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]  # a text's end also ends its last word
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, range_hashes(data, start, end), start, end, np.searchsorted(start, cuts))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, which must not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; those that cross a text's end are the caller's to leave out."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    n = len(hashes) - size + 1
    return mix((sums[size:] - sums[:n]) * down[:n])
