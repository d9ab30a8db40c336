"""Vectorised word scanning of Arrow text columns, shared by the operators.

Texts stay in the Arrow buffer of a batch: words are found by a byte-class
table, and every word gets a 64-bit hash from prefix sums, so no Python string
is made per word.  All separators are ASCII and UTF-8 never uses ASCII bytes
inside a longer character, so byte classes equal the code-point classes.

A null text counts as an empty one.  Two different words of one corpus get the
same 64-bit hash with a chance of about (distinct words)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are scanned in runs of whole documents of about this many bytes.
CHUNK_BYTES = 1 << 20
#: Rows and bytes in an Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_class(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = ~_byte_class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = _byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


class Texts(NamedTuple):
    """Some whole texts: ``data[offsets[i]:offsets[i + 1]]`` is the i-th."""

    first: int  # place of the first text in its batch
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.offsets.size - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    starts: np.ndarray  # byte places in ``data``
    ends: np.ndarray
    offsets: np.ndarray  # words of text i are offsets[i]..offsets[i + 1]
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.offsets.size - 1), self.counts)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts of a string column, in order, about ``size`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), len(column))
        yield Texts(a, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        a = b


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)
    return run(_BASE), run(_BASE_INV)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES * 2
    while size < n + 1:
        size *= 2
    return _powers(size)


def lowered(texts: Texts) -> Texts:
    """A-Z in lower case; other letters stay."""
    return texts._replace(data=_LOWER[texts.data])


def words(texts: Texts, kind: np.ndarray) -> Words:
    """The words of ``kind`` (a byte-class table) in texts already lower-cased."""
    data, offsets = texts.data, texts.offsets
    n = data.size
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(offsets.size, np.int64), np.zeros(0, np.uint64))
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts]
                   + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def run_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``length`` words inside one text."""
    n = w.hashes.size
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - length + 1, np.uint64)
    for j in range(length):
        total += w.hashes[j:n - length + 1 + j] * _U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    last_start = np.repeat(w.offsets[1:] - length, w.counts)[:n - length + 1]
    first = np.flatnonzero(np.arange(n - length + 1) <= last_start)
    return first, mix64(total[first] + _U(length))
