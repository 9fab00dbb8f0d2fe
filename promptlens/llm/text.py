"""Texts as byte buffers: what the operators that work on bytes and words share.

Everything here runs inside tasks, on Arrow batches that Spark hands over, and is vectorised
over a bounded piece of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is one piece.
PIECE_BYTES = 512 << 10

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@cache
def byte_codes() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_ODD))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, PIECE_BYTES + 1), base & _MASK, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 2 * PIECE_BYTES:  # kept from call to call, in every worker
            _powers[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of code(byte k) * base**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes()[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes hash equally wherever they stand."""
    inverse = powers(pow(_BASE, -1, 1 << 64), len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of bounded runs of rows; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes that lies within one row."""
    n = len(is_word)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
