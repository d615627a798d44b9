"""Text columns as flat numpy buffers: the words of many texts in one pass.

An Arrow string column is one run of UTF-8 bytes with offsets.  The helpers here find
words and hash them over that run with a handful of numpy calls, in blocks of bounded
size, so that the Python workers keep to a fixed memory whatever the batch holds.  Only
a single text longer than a block makes a block larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a block: byte ranges [start, end) and the index of the text each is in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def byte_table(excluded: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, bool)
    table[list(excluded)] = False
    return table


#: Everything but blank characters.
NOT_BLANK = byte_table(b" \t\n\x0b\x0c\r")
#: ASCII letters and digits and all of non-ASCII.
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: A to Z in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run ends where its text ends."""
    inside = table[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial modulo 2**64, scrambled with its length."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        n = size[full]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        within = at - np.repeat(first, n)
        powers = np.multiply.accumulate(np.full(int(n.max()), _ODD))
        out[full] = np.add.reduceat((data[within + np.repeat(start[full], n)].astype(np.uint64) + np.uint64(1)) * powers[within], first)
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of one text, and the index of each window's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    out = np.zeros(len(whole), np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[whole + k]
    return mix(out), whole


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums by text."""
    return np.bincount(doc, values, n).astype(np.int64)
