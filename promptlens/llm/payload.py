"""Many small rows as one binary value per key: what shards and buckets exchange."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def columns(rows: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in rows.dtype.names)


def planes(rows: np.ndarray) -> bytes:
    """Field after field and in each byte after byte: ids and places, alike in their upper bytes, compress to few."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T).tobytes() for f in rows.dtype.names)


def rows_of_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at = np.empty(n, dtype=kind), 0
    for f in kind.names:
        size = kind[f].itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind[f]).ravel()
        at += n * size
    return out


def rows_of(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    out, at = np.empty(n, dtype=kind), 0
    for f in kind.names:
        out[f] = np.frombuffer(data, dtype=kind[f], count=n, offset=at)
        at += kind[f].itemsize * n
    return out


def pack(key: np.ndarray, rows: np.ndarray, encode: Callable[[np.ndarray], bytes] = columns) -> pa.RecordBatch:
    """A record (k, data) for each key with all its rows."""
    order = np.argsort(key, kind="stable")
    key, rows = key[order], rows[order]
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(key))
    return pa.RecordBatch.from_arrays(
        [pa.array(key[edge], pa.int64()), pa.array([encode(rows[a:b]) for a, b in zip(edge, ends)], pa.binary())], ["k", "data"]
    )


def unpack(table: pa.Table, kind: np.dtype, decode: Callable[[bytes, np.dtype], np.ndarray] = rows_of) -> np.ndarray:
    parts = [decode(x, kind) for x in table.column("data").to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype=kind)


def bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    folded = ids.view(np.uint64)
    folded = folded ^ (folded >> np.uint64(7)) ^ (folded >> np.uint64(19))
    return folded.view(np.int64) % buckets


def bucket_column(ids: Column, buckets: int) -> Column:
    folded = ids.bitwiseXOR(F.shiftrightunsigned(ids, 7)).bitwiseXOR(F.shiftrightunsigned(ids, 19))
    return F.pmod(folded, F.lit(buckets).cast("long"))
