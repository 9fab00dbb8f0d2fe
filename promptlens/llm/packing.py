"""Packing token sequences into fixed room by sums of squares."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm import text as X
from promptlens.llm.tokens import encode_batch

#: Documents whose pieces are packed together, on average. Each group leaves at most a few
#: sequences open, so larger groups gain little.
GROUP_DOCS = 100_000
_NONE = np.iinfo(np.int64).max


def pieces_of(size: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of full length but, where it doesn't divide, the first."""
    if size <= room:
        return [(0, size)]
    first = size % room or room
    return [(0, first), *((start, room) for start in range(first, size, room))]


def _cut(path: str, ranks, room: int, end: int | None, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def cut(batches):
        for batch in batches:
            keys = X.column(batch, "id")
            for first, rows in encode_batch(X.column(batch, "text"), path, ranks):
                at, piece, start, length, crc, body = [], [], [], [], [], []
                for k, ids in enumerate(rows):
                    if end is not None:
                        ids = np.append(ids, np.uint32(end))
                    ids = ids.astype("<u4", copy=False)
                    for p, (a, n) in enumerate(pieces_of(len(ids), room)):
                        part = ids[a : a + n].tobytes()
                        at.append(first + k)
                        piece.append(p)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            body.append(part)
                out = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(body, pa.binary())] if with_ids else [])], names)

    return cut


def sum_of_squares(sizes: np.ndarray, room: int, sparing: bool = False) -> list[list[int]]:
    """Sequences as lists of places in ``sizes``, each placed where the squared counts of open sequences
    per remaining room sum to least; an open sequence goes before a new one on a tie, and on a tie of open ones the one
    that is left with least room. If ``sparing``, a new one is opened only where no open one has room."""
    count = np.zeros(room + 1, dtype=np.int64)  # open sequences by the room they have left
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    out: list[list[int]] = []
    for k, size in enumerate(sizes.tolist()):
        if size >= room:
            out.append([k])
            continue
        here = count[size:room]
        change = np.where(here > 0, 2 * (count[: room - size] - here) + 2, _NONE)
        if here[0]:
            change[0] = 1 - 2 * here[0]  # it is full then and no longer counts
        best = int(change.argmin())
        if change[best] <= (_NONE - 1 if sparing else 2 * count[room - size] + 1):
            left = best
            sequence = open_at[best + size].pop()
            count[best + size] -= 1
        else:
            left = room - size
            sequence = len(out)
            out.append([])
        out[sequence].append(k)
        if left:
            count[left] += 1
            open_at[left].append(sequence)
    return out


def pack_sizes(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Largest first by sums of squares, in two ways, of which the one with fewer sequences is taken: sparing from the
    start; or free to open sequences, with the pieces of those that stay open placed once more, sparing."""
    order = np.argsort(-sizes, kind="stable")

    def placed(of: np.ndarray, sparing: bool) -> list[list[int]]:
        return [of[x].tolist() for x in sum_of_squares(sizes[of], room, sparing)]

    spare, free = placed(order, True), placed(order, False)
    full = [x for x in free if int(sizes[x].sum()) == room]
    rest = sorted((k for x in free if int(sizes[x].sum()) < room for k in x), key=lambda k: (-int(sizes[k]), k))
    return min(spare, full + placed(np.array(rest, dtype=np.int64), True), key=len)


def _pack(room: int):
    def pack(key, table):
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for number, places in enumerate(pack_sizes(sizes, room)):
            sequence[places] = number
            offset[places] = np.cumsum(sizes[places]) - sizes[places]
        sequence += key[0].as_py() << 40
        out = table.drop_columns(["deal"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def pack(
    docs: DataFrame, path: str, ranks: tuple | None = None, room: int = 1024, end: int | None = None, id: str = "doc_id", text: str = "text", group_docs: int = GROUP_DOCS
) -> DataFrame:
    """Place every document's tokens, cut only where they exceed ``room``, in as few sequences as possible.

    A document is its token ids (see ``tokens.encode``) and then ``end``, if given. Returns per piece: id,
    ``piece``, ``start``, ``length``, ``ids_crc32`` (of the ids as little-endian 32-bit numbers), ``sequence_id`` and
    ``offset``. Only numbers are shuffled; pieces are dealt evenly to groups, each packed in one task.

    A null text is empty, so its document is ``end`` alone (one empty piece without it). Null ids and
    repeated rows are packed row by row. An empty table gives an empty result; other columns never matter.
    """
    groups = docs.count() // group_docs + 1
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["id"]
    numbers = "piece int, start long, length long, ids_crc32 long"
    pieces = base.mapInArrow(_cut(path, ranks, room, end, False), f"id {kind}, {numbers}")
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    placed = dealt.groupBy("deal").applyInArrow(_pack(room), f"id {kind}, {numbers}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id)


def sequences(docs: DataFrame, placed: DataFrame, path: str, ranks: tuple | None = None, room: int = 1024, end: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids`` (little-endian 32-bit numbers) of each.

    Rows that repeat an id need their own sequences, so ids must be unique here.
    """
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["id"]
    bodies = base.mapInArrow(_cut(path, ranks, room, end, True), f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    places = placed.select(F.col(id).alias("id"), "piece", "sequence_id", "offset")
    parts = bodies.select("id", "piece", "ids").join(places, ["id", "piece"])
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda all, x: F.concat(all, x["ids"])).alias("ids"))
