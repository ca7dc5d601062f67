"""Vectorised word scanning over Arrow text columns.

Texts are handled as UTF-8 bytes in blocks of whole documents, so memory is bounded by the block
size or, where one document is longer, by that document. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_set(regex_members: str) -> np.ndarray:
    """Bytes that a class of words leaves out; every byte above 0x7F belongs to a word."""
    table = np.ones(256, bool)
    table[[ord(c) for c in regex_members]] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _byte_set(" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = _byte_set("".join(chr(c) for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (wrapping arithmetic)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2^64."""
    if _POWERS[0].size < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def running(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes the hash of any byte range out of them."""
    up, _ = powers(data.size)
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from ``start`` to ``end``; equal bytes hash equally wherever they stand."""
    _, down = powers(sums.size)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


@dataclass
class Block:
    """Whole documents ``first .. first + len(offsets) - 1`` of a batch, as one run of bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return self.offsets.size - 1


@dataclass
class Words:
    """Byte spans of words; ``bounds[d]`` is the first word of document ``d``, ``doc`` each word's document."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """Cuts a text column into blocks of about ``limit`` bytes, never within a document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    rows = len(column)
    if rows == 0:
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset: column.offset + rows + 1]
    whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield Block(first, whole[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first])
        first = last


def words(block: Block, data: np.ndarray, table: np.ndarray) -> Words:
    """Spans of maximal runs of bytes in ``table``, cut at document borders."""
    n = data.size
    inside = table[data]
    border = np.zeros(n + 1, bool)
    border[block.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:n]
    ends[:-1] &= ~inside[1:] | border[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, block.offsets)
    return Words(start, end, bounds, np.repeat(np.arange(block.size), np.diff(bounds)))


_STEP = [int(v) | 1 for v in mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F))]


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes, documents' borders not looked at."""
    size = max(hashes.size - n + 1, 0)
    out = np.full(size, n * 0x2545F4914F6CDD1D & (1 << 64) - 1, np.uint64)
    for j in range(n):
        out += hashes[j: j + size] * _U(_STEP[j])
    return mix(out)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Which ``n`` consecutive words lie in one document."""
    size = max(doc.size - n + 1, 0)
    return doc[:size] == doc[n - 1: n - 1 + size]


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Positions below ``size`` that lie in one of the windows of ``length`` at ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of word values in each document."""
    sums = np.zeros(values.size + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
