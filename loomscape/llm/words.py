"""Words of whole Arrow string columns as 64-bit hashes, vectorised in numpy.

Word hashes are polynomials over random byte values modulo 2**64, taken as differences
of prefix sums, then mixed; all are functions of the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20  # bytes of text that are worked on at once; a longer text is a block of its own

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]  # A-Z count as a-z


def _mask(codes) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[list(codes)] = True
    return m


#: Words of [^\x20\x09-\x0D]+
NON_SPACE = ~_mask([0x20, *range(0x09, 0x0E)])
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-case
ALNUM = _mask([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_pow: np.ndarray = np.ones(1, dtype=np.uint64)
_inv: np.ndarray = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, BLOCK + (BLOCK >> 1))
        _pow = np.full(n, _BASE, dtype=np.uint64)
        _inv = np.full(n, _BASE_INV, dtype=np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.cumprod(_pow), np.cumprod(_inv)
    return _pow, _inv


@dataclass
class Block:
    """Texts first..first+len(at)-2 of a column. Words of text i: at[i] up to at[i+1]."""

    first: int
    at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # of words, in bytes from the block's begin
    ends: np.ndarray
    data: np.ndarray  # the block's bytes
    text_at: np.ndarray  # of texts, in bytes from the block's begin


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def text_blocks(at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about most bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_blocks(column: pa.Array, is_word: np.ndarray, hashed: bool = True) -> Iterator[Block]:
    """The words of every text, in order, by blocks of texts."""
    data, at = text_buffers(column)
    for i, j in text_blocks(at):
        own = at[i : j + 1] - at[i]
        raw = data[at[i] : at[j]]
        n = len(raw)
        inside = is_word[raw]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edge = own[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            before[edge] = False
            after[edge - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        hashes = np.zeros(0, np.uint64)
        if hashed and n:
            power, inverse = _powers(n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_VALUE[raw] * power[:n], out=total[1:])
            hashes = mix((total[ends] - total[starts]) * inverse[starts])
        yield Block(i, np.searchsorted(starts, own), hashes, starts, ends, raw, own)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * LANES[0]
    for k in range(1, size):
        total = total + hashes[k : k + n] * LANES[k]
    return mix(total)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of one text; a shorter text is one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes, min(size, len(hashes))) + U(min(size, len(hashes))))
