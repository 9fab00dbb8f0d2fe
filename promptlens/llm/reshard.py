"""Moving documents from old shards to new ones with as few bytes as possible, by minimum-cost flow."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm.graph import _kept

#: Blocks an old shard is dealt into; the driver sees one size for each block and shard.
BLOCKS = 256
MOST_SHARDS = 1024
#: Bytes of text in a written file, about; a block is never split.
FILE_BYTES = 128 << 20


def transport(supply: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """Bytes that go from each old shard to each new one, the fewest possible to another number.

    Shortest augmenting paths with potentials in the network source - old - new - sink; staying costs
    nothing, moving one per byte.
    """
    old, new = len(supply), len(room)
    source, sink = old + new, old + new + 1
    ends: list[int] = []
    left: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(old + new + 2)]

    def edge(a: int, b: int, most: int, price: int) -> None:
        for x, y, m, p in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(ends))
            ends.append(y)
            left.append(m)
            cost.append(p)

    for i, size in enumerate(supply):
        edge(source, i, size, 0)
        for j in range(new):
            edge(i, old + j, size, int(i != j))
    for j, size in enumerate(room):
        edge(old + j, sink, size, 0)
    price = [0] * len(out)
    while True:
        far = {source: 0}
        via: dict[int, int] = {}
        queue = [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if left[e]:
                    y, n = ends[e], d + cost[e] + price[x] - price[ends[e]]
                    if n < far.get(y, 1 << 60):
                        far[y], via[y] = n, e
                        heapq.heappush(queue, (n, y))
        if sink not in far:
            break
        for x, d in far.items():
            price[x] += d
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = ends[via[x] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount
    flow = {}
    for i in range(old):
        for e in out[i]:
            if e % 2 == 0 and left[e ^ 1]:
                flow[i, ends[e] - old] = left[e ^ 1]
    return flow


@dataclass(frozen=True)
class Plan:
    """Where every document goes: what a task needs to know, one row a block.

    ``cells`` (old, block, pieces) says to which shards a block goes, each piece but the last with the last of its rows;
    ``bases`` (shard, old, block, base, part) where its rows lie in the shard, and in which file.
    """

    old: Column
    blocks: int
    id: str
    text: str
    cells: DataFrame
    bases: DataFrame
    torn: bool
    untouched: list[int]

    def place(self, docs: DataFrame, only: list[int] | None = None) -> DataFrame:
        """The rows (of some shards) with ``_row`` (id, size, crc, old, block, shard, slot), dealt once by shard and file, in
        slot order. A frame may bring measured rows (``_row`` without shard and slot) in place of texts."""
        key = F.struct(*(F.col(f"_row.{c}") for c in ("id", "crc", "size")))
        rows = docs if "_row" in docs.columns else docs.withColumn("_row", _measured(self))
        columns = [c for c in docs.columns if c != "_row"]
        # both tables have a row for each block, whose number the caller sets
        rows = rows.join(F.broadcast(self.cells), (F.col("_row.old") == F.col("_old")) & (F.col("_row.block") == F.col("_block")))
        copy = F.lit(1).cast("long")
        if self.torn:  # equal rows on both sides of a cut are told apart by number
            at_cut = F.exists("_pieces", lambda p: F.coalesce(p["last"] == key, F.lit(False)) & (p["k"] < p["m"]))
            same = W.partitionBy("_old", "_block", key).orderBy("_old")
            rows = rows.where(~at_cut).withColumn("_copy", copy).unionByName(rows.where(at_cut).withColumn("_copy", F.row_number().over(same).cast("long")))
            copy = F.col("_copy")

        def holds(p: Column) -> Column:
            return p["last"].isNull() | (key < p["last"]) | ((key == p["last"]) & ((p["k"] == p["m"]) | (copy <= p["k"])))

        rows = rows.withColumn("_shard", F.element_at(F.filter("_pieces", holds), 1)["shard"])
        if only is not None:
            rows = rows.where(F.col("_shard").isin(only))
        bases = self.bases.select(F.col("shard").alias("_shard"), F.col("old").alias("_old"), F.col("block").alias("_block"), "_base", "_part")
        rows = rows.join(F.broadcast(bases), ["_shard", "_old", "_block"]).repartition("_shard", "_part")
        order = W.partitionBy("_shard", "_part", "_old", "_block").orderBy("_row.id", "_row.crc", "_row.size")
        slot = (F.col("_base") + F.row_number().over(order)).cast("long")
        return rows.withColumn("_row", F.struct("_row.*", F.col("_shard").alias("shard"), slot.alias("slot"))).select(*columns, "_row")


def _measured(plan: Plan) -> Column:
    content = F.coalesce(F.col(plan.text), F.lit(""))
    size, crc = F.octet_length(content) + F.lit(1).cast("long"), F.crc32(content)
    block = F.pmod(F.xxhash64(F.col(plan.id), crc), F.lit(plan.blocks)).cast("int")
    return F.struct(F.col(plan.id).alias("id"), size.alias("size"), crc.alias("crc"), F.coalesce(plan.old.cast("int"), F.lit(0)).alias("old"), block.alias("block"))


def plan(docs: DataFrame, old: Column, old_shards: int, new_shards: int, id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> Plan:
    """Assign every document to one of ``new_shards`` shards of nearly equal bytes, moving the fewest bytes.

    ``old`` gives a document's present shard, 0 to ``old_shards`` - 1. A document's size is its
    text's UTF-8 bytes plus 1. Each old shard is a fixed sequence of ``blocks`` blocks (by hash, then id); the flow says
    how many bytes of it go where, what stays coming first, and a document goes where its middle
    byte does, so each shard is off by half a document per cut at most. Only sizes of blocks, and one row for each
    cut, reach the driver. A block is the least that one task numbers: give ``blocks`` so that one has some hundred MB at most.

    A null text has no bytes; null ids come first in their block; a null old shard counts as shard 0; rows that repeat an
    id are placed row by row; an empty table has an empty plan; other columns never matter.
    """
    if not 0 < max(old_shards, new_shards) <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards")
    spark = docs.sparkSession
    out = Plan(old, blocks, id, text, docs, docs, False, [])
    rows = _kept(docs.select(_measured(out).alias("r")).select("r.*"), "sizes")
    sizes = [[0] * blocks for _ in range(old_shards)]
    counts = [[0] * blocks for _ in range(old_shards)]
    for r in rows.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # one row a block
        sizes[r["old"]][r["block"]], counts[r["old"]][r["block"]] = r["size"], r["n"]
    total = sum(map(sum, sizes))
    room = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = transport([sum(x) for x in sizes], room)
    whole: list[tuple[int, int, int]] = []  # old, block, shard
    cut: list[tuple[int, int, int, list]] = []  # old, block, start, limits
    for i in range(old_shards):
        to = sorted(((j, n) for (k, j), n in flow.items() if k == i), key=lambda x: (x[0] != i, x[0]))
        limits, at = [], 0
        for j, n in to:
            at += n
            limits.append((2 * at, j))
        at = 0
        for b in range(blocks):
            end = at + sizes[i][b]
            if counts[i][b]:
                if any(2 * at < upto < 2 * end for upto, _ in limits):
                    cut.append((i, b, at, limits))
                else:
                    whole.append((i, b, next(j for upto, j in limits if upto >= 2 * end)))
            at = end
    pieces = {(i, b): [(None, 1, 1, j)] for i, b, j in whole}
    held = [(j, i, b, counts[i][b], sizes[i][b]) for i, b, j in whole]  # shard, old, block, rows, bytes
    key = F.struct("id", "crc", "size")
    if cut:
        starts = spark.createDataFrame(cut, "old int, block int, start long, limits array<struct<upto: long, shard: int>>")
        order = W.partitionBy("old", "block").orderBy("id", "crc", "size")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        near = rows.join(F.broadcast(starts), ["old", "block"]).withColumn("middle", 2 * (F.col("start") + before) + F.col("size"))
        target = F.element_at(F.filter("limits", lambda x: F.col("middle") < x["upto"]), 1)["shard"]
        near = near.withColumns({"shard": F.coalesce(target, F.element_at("limits", -1)["shard"]), "at": F.row_number().over(order)})
        same = W.partitionBy("old", "block", "id", "crc", "size")
        near = near.withColumns({"k": F.row_number().over(same.orderBy("at")).cast("long"), "m": F.count("*").over(same)})
        ends = near.groupBy("old", "block", "shard").agg(F.max(F.struct("at", key.alias("last"), "k", "m")).alias("end"), F.count("*").alias("n"), F.sum("size").alias("size"))
        for r in sorted(ends.collect(), key=lambda r: r["end"]["at"]):  # a row for each cut, and one for each block that is cut
            held.append((r["shard"], r["old"], r["block"], r["n"], r["size"]))
            pieces.setdefault((r["old"], r["block"]), []).append((r["end"]["last"], r["end"]["k"], r["end"]["m"], r["shard"]))
    for found in pieces.values():
        found[-1] = (None, 1, 1, found[-1][3])
    last = T.StructType([rows.schema["id"], rows.schema["crc"], rows.schema["size"]])
    piece = T.StructType([T.StructField("last", last), T.StructField("k", T.LongType()), T.StructField("m", T.LongType()), T.StructField("shard", T.IntegerType())])
    kind = T.StructType([T.StructField("_old", T.IntegerType()), T.StructField("_block", T.IntegerType()), T.StructField("_pieces", T.ArrayType(piece))])
    cells = spark.createDataFrame([(i, b, found) for (i, b), found in pieces.items()], kind)
    bases, filled, weight = [], [0] * new_shards, [0] * new_shards
    for j, i, b, n, size in sorted(held):
        bases.append((j, i, b, filled[j] - 1, weight[j] // FILE_BYTES))
        filled[j] += n
        weight[j] += size
    bases = spark.createDataFrame(bases, "shard int, old int, block int, _base long, _part long")
    torn = any(k < m for found in pieces.values() for _, k, m, _ in found)
    moved = {x for j, i, _, _, _ in held if i != j for x in (i, j)}
    return Plan(old, blocks, id, text, cells, bases, torn, sorted({j for j, *_ in held} - moved))


def reshard(docs: DataFrame, old: Column, old_shards: int, new_shards: int, id: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """The assignment of :func:`plan` as a row for each row: id, ``size``, ``text_crc32``, ``old_shard``, ``shard`` and ``slot``
    (numbered from 0 without gaps in each shard)."""
    return assigned(docs, plan(docs, old, old_shards, new_shards, id, text, blocks))


def assigned(docs: DataFrame, plan: Plan, only: list[int] | None = None) -> DataFrame:
    """What :func:`reshard` gives, for all shards or some; no text is moved for it."""
    rows = plan.place(docs.select(_measured(plan).alias("_row")), only)
    return rows.select(F.col("_row.id").alias(plan.id), "_row.size", F.col("_row.crc").alias("text_crc32"), F.col("_row.old").alias("old_shard"), "_row.shard", "_row.slot")


def rewrite(docs: DataFrame, plan: Plan, path: str) -> list[int]:
    """Write the shards that gain or lose documents, each as a folder ``shard=N`` of files in the order of their slots.

    Each document's text moves once, to the task that writes its file. Returns the shards that stay as they are, whose old
    files are kept. Columns ``shard`` and ``slot`` replace any of these names.
    """
    changed = sorted({r["shard"] for r in plan.bases.select("shard").distinct().collect()} - set(plan.untouched))  # shard numbers
    rows = plan.place(docs.drop("shard", "slot") if plan.id not in ("shard", "slot") else docs, changed)
    rows.withColumns({"slot": F.col("_row.slot"), "shard": F.col("_row.shard")}).drop("_row").write.mode("overwrite").partitionBy("shard").parquet(path)
    return plan.untouched
