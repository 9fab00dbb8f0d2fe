"""Training order: every sequence gets a place by a keyed permutation, and shards are written in that order."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptlens.llm import text as X
from promptlens.llm.packing import pieces_of
from promptlens.llm.tokens import encode_batch
from promptlens.session import scratch_path

ROUNDS = 6
SHARD_ROWS = 8192
BLOCK_ROWS = 256  # records of a shard that are stored as one value
FILE_SHARDS = 4  # shards that follow each other in one file, which one task sorts and writes
BUCKETS = 1024  # the driver sees one count for each


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. n-1 that depends on ``key``: a Feistel network over the least even number of bits that
    holds n, walked along its cycle until the value is below n."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = X.mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (X.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (X.mix(right ^ k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def body_of(ids: np.ndarray, end: int | None, kind: str) -> bytes:
    """The ids, and ``end`` if given, in the stored width; ids that don't fit are an error."""
    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
        raise ValueError(f"token id {int(ids.max())} needs wide records")
    return (np.append(ids, np.uint32(end)) if end is not None else ids).astype(kind).tobytes()


def _encode(path: str, ranks, end: int | None, kind: str, length: int):
    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, rows in encode_batch(X.column(batch, "text"), path, ranks):
                bodies = [body_of(ids, end, kind) for ids in rows]
                n = np.array([max(1, -(-len(b) // (length * np.dtype(kind).itemsize))) for b in bodies], dtype=np.int64)
                own = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [X.column(own, "id"), pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(bodies, pa.binary()), pa.array(n),
                     pa.array(np.full(len(n), part, np.int64)), pa.array(before + np.cumsum(n) - n)], ["id", "crc", "data", "n", "part", "first"]
                )
                before += int(n.sum())

    return encode


def _place(total: int, key: int, length: int, pad: int, kind: str, shard_rows: int):
    def place(batches):
        for batch in batches:
            ids, data, base = X.column(batch, "id"), X.column(batch, "data"), X.column(batch, "base").to_numpy()
            at, piece, n, index, bodies = [], [], [], [], []
            for k in range(batch.num_rows):
                own = np.frombuffer(data[k].as_py(), kind)
                for p, (a, size) in enumerate(pieces_of(len(own), length)):
                    record = np.full(length, pad, kind)
                    record[:size] = own[a : a + size]
                    at.append(k)
                    piece.append(p)
                    n.append(size)
                    index.append(int(base[k]) + p)
                    bodies.append(record.tobytes())
            slot = permuted(np.array(index), total, key)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(slot // shard_rows), pa.array(slot), pa.array(bodies, pa.binary())],
                ["id", "piece", "n_tokens", "shard", "slot", "record"],
            )

    return place


def _block(held: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"id": id_type, "piece": pa.int32(), "n_tokens": pa.int32()}
    lists = [pa.array([[r[c] for r in held]], pa.list_(kind)) for c, kind in kinds.items()]
    crc = pa.array([[zlib.crc32(r["record"]) for r in held]], pa.list_(pa.int64()))
    body = pa.array([b"".join(r["record"] for r in held)], pa.binary())
    first = [pa.array([held[0][c]]) for c in ("shard", "slot")]
    return pa.RecordBatch.from_arrays([*first, *lists, crc, body], ["shard", "first_slot", "ids", "pieces", "n_tokens", "crc32", "records"])


def _blocks(batches):
    """Records that follow each other, some at a time; slots come sorted within each shard."""
    held: list[dict] = []
    for batch in batches:
        id_type = batch.schema.field("id").type
        for row in batch.to_pylist():
            if held and (row["shard"] != held[0]["shard"] or len(held) == BLOCK_ROWS):
                yield _block(held, id_type)
                held = []
            held.append(row)
    if held:
        yield _block(held, id_type)


def materialise(
    docs: DataFrame, path: str, target: str, key: int, ranks: tuple | None = None, length: int = 1024, end: int | None = None, pad: int = 0, wide: bool = False,
    id: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS, by_id: bool = False, file_shards: int = FILE_SHARDS,
) -> int:
    """Write all texts' token sequences to ``target`` in training order; returns how many there are.

    A document's ids (and ``end``, if given) are cut into sequences of ``length``, the first shorter if need be and
    padded. The ids are stored first, and sequences are numbered as they lie there; with ``by_id`` by document
    (hash bucket, then id), which moves the ids once more but doesn't depend on how the input is laid out. The keyed permutation gives each
    number its slot. Shard s holds the slots from s * ``shard_rows``
    on, each record as ``length`` little-endian 16-bit numbers (32-bit if ``wide``), so a record's
    place follows from its slot alone. An id, ``end`` or ``pad`` that doesn't fit the width is an error.

    Slots are spread evenly, so range partitions need no sample: each holds the slots of ``file_shards`` shards that
    follow each other, is sorted by one task and becomes one file; raise it where there would be too many. Stored as Parquet
    rows of up to ``BLOCK_ROWS`` records: ``shard``, ``first_slot``, ``ids``, ``pieces``, ``n_tokens``, ``crc32`` (an array
    element for each record) and ``records``. A record's ``offset`` (see ``manifest``) is its place in the records
    of its shard, one after the other, not in the Parquet file around them.

    A null text is empty (its document is ``end``, or a record of padding); null ids and repeated rows
    have sequences of their own; an empty table writes no record. Other columns never matter.
    """
    spark = docs.sparkSession
    kind = "<u4" if wide else "<u2"
    if max(end or 0, pad) > np.iinfo(kind).max:
        raise ValueError("end or padding needs wide records")
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    of_id = dict(base.dtypes)["id"]
    store = scratch_path(spark, "token-ids")
    schema = f"id {of_id}, crc long, data binary, n long, part long, first long"
    base.mapInArrow(_encode(path, ranks, end, kind, length), schema).write.option("compression", "zstd").parquet(store)
    rows = spark.read.schema(schema).parquet(store)
    if by_id:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(BUCKETS)))
        order = W.partitionBy("part").orderBy("id", "crc").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    total, starts = 0, []
    sizes = rows.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a number for each bucket, or for each task that wrote
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    numbered = rows.join(starts, "part").withColumn("base", F.col("start") + F.col("first"))
    placed = numbered.select("id", "data", "base").mapInArrow(
        _place(total, key, length, pad, kind, shard_rows), f"id {of_id}, piece int, n_tokens int, shard long, slot long, record binary"
    )
    files = max(1, -(-total // (shard_rows * file_shards)))
    sorted_rows = placed.repartitionById(files, F.floor(F.col("shard") / file_shards).cast("int")).sortWithinPartitions("slot")
    blocks = f"shard long, first_slot long, ids array<{of_id}>, pieces array<int>, n_tokens array<int>, crc32 array<long>, records binary"
    sorted_rows.mapInArrow(_blocks, blocks).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return total


def manifest(spark: SparkSession, target: str, width: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each record: id, ``piece``, ``n_tokens``, ``slot``, ``shard``, ``offset`` in bytes within the shard's records, ``crc32``."""
    rows = spark.read.parquet(target).select("shard", "first_slot", F.posexplode(F.arrays_zip("ids", "pieces", "n_tokens", "crc32")).alias("at", "r"))
    slot = F.col("first_slot") + F.col("at")
    return rows.select(F.col("r.ids").alias("id"), F.col("r.pieces").alias("piece"), F.col("r.n_tokens").alias("n_tokens"), slot.alias("slot"), "shard", ((slot - F.col("shard") * shard_rows) * width).alias("offset"), F.col("r.crc32").alias("crc32"))


def resume(spark: SparkSession, target: str, slot: int) -> DataFrame:
    """The stored blocks from the one that holds ``slot`` on, in order: where a stopped run goes on reading. Files of
    earlier slots are skipped by their statistics."""
    rows = spark.read.parquet(target).where((F.col("first_slot") > slot - BLOCK_ROWS) & (F.col("first_slot") + F.size("ids") > slot))
    return rows.orderBy("first_slot")
