"""A prefix trie of conversations, built by halving the depth of its sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptlens.llm.graph import _kept
from promptlens.llm.sequence import short_hash

#: Depths that one window names; deeper cuts are named from one row in so many.
BLOCK = 1024
#: Ids that are joined to one text before a node's ends are hashed.
ENDS = 4096


def _root() -> Column:
    return F.unhex(F.lit("00" * 16))


def _low(d: Column) -> Column:
    """The largest power of two that divides d: how far below its cut a depth is named."""
    return d.bitwiseAND(-d)


def _halves(d: Column, dig: str, most: int, own: W) -> list[Column]:
    """Steps that fold digests so that a row's covers as many turns, up to itself, as _low says."""
    steps, half = [], 1
    while 2 * half <= most:
        steps.append(F.when(d % (2 * half) == 0, short_hash(F.lag(dig, half).over(own), F.col(dig))).otherwise(F.col(dig)))
        half *= 2
    return steps


def _names(rows: DataFrame, d: Column, most: int, own: W, root: Column) -> DataFrame:
    """Name the cuts from half the depth down: a prefix by the name of its own cut and the digest of the rest."""
    half = most
    rows = rows.withColumn("name", F.lit(None).cast("binary"))
    while half >= 1:
        cut = F.coalesce(F.lag("name", half).over(own), root)
        rows = rows.withColumn("name", F.when(_low(d) == half, short_hash(cut, F.col("seg"))).otherwise(F.col("name")))
        half //= 2
    return rows


def named(turns: DataFrame) -> DataFrame:
    """Turns (conv, d, digest, bytes; d from 1 without gaps) with the name of each prefix of d turns.

    Van Emde Boas order: a block of depths is cut at its half; the digest of the upper half names the cut
    prefixes, which are the roots of the lower forests; both halves are cut alike. All cuts of one size
    are one step over all blocks. Equal sequences, and no others, have equal names (128 bits).
    """
    deepest = turns.agg(F.max("d")).first()[0] or 0
    block = F.shiftright(F.col("d") - 1, BLOCK.bit_length() - 1)
    rows = turns.withColumn("block", block).withColumn("seg", F.col("digest"))
    own = W.partitionBy("conv", "block").orderBy("d")
    top = 1
    while top <= min(deepest, BLOCK) // 2:
        top *= 2
    for step in _halves(F.col("d"), "seg", top, own):
        rows = rows.withColumn("seg", step)
    rows = rows.withColumn("root", _root())
    if deepest >= BLOCK:  # one row in BLOCK: the cuts above all blocks
        rows = _kept(rows.drop("root"), "segments")
        e, whole = F.shiftright("d", BLOCK.bit_length() - 1), W.partitionBy("conv").orderBy("d")
        cuts = rows.where(F.col("d") % BLOCK == 0).select("conv", "d", "seg").withColumn("e", e)
        high = 1
        while high <= (deepest // BLOCK) // 2:
            high *= 2
        for step in _halves(F.col("e"), "seg", high, whole):
            cuts = cuts.withColumn("seg", step)
        cuts = _kept(_names(cuts, F.col("e"), high, whole, _root()).select("conv", "e", "name"), "cuts")
        roots = cuts.select("conv", F.col("e").alias("block"), F.col("name").alias("root"))
        inner = _names(rows.join(roots, ["conv", "block"], "left").withColumn("root", F.coalesce("root", _root())), F.col("d") % BLOCK, BLOCK // 2, own, F.col("root"))
        above = cuts.select("conv", (F.col("e") * BLOCK).alias("d"), F.col("name").alias("cut"))
        rows = inner.join(above, ["conv", "d"], "left").withColumn("name", F.coalesce("cut", "name"))
    else:
        rows = _names(rows, F.col("d"), top, own, F.col("root"))
    parent = F.coalesce(F.lag("name").over(own), F.col("root"))
    return rows.select("conv", "d", "bytes", "name", parent.alias("up"))


_TEXTS = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])


def _rows(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(kind), kind)], schema=kind)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv) to texts of at most ENDS ids each: (name, first, ids)."""
    name, ids = None, []
    for batch in batches:
        done = []
        for n, c in zip(batch.column("name").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (n != name or len(ids) == ENDS):
                done.append((name, ids[0], ",".join(map(str, ids))))
                ids = []
            name = n
            ids.append(c)
        yield _rows(done, _TEXTS)
    if ids:
        yield _rows([(name, ids[0], ",".join(map(str, ids)))], _TEXTS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, first, ids) to the SHA-256 of each name's ids; only the running hash is held."""
    name, running = None, None
    for batch in batches:
        done = []
        for n, text in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
            if n != name:
                if running is not None:
                    done.append((name, running.hexdigest()))
                name, running = n, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
        yield _rows(done, _HASHED)
    if running is not None:
        yield _rows([(name, running.hexdigest())], _HASHED)


def _ends(lasts: DataFrame) -> DataFrame:
    ranged = lasts.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    texts = ranged.mapInArrow(_joined, "name binary, first long, ids string")
    return texts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends_sha256 string")


def _grafted(totals: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """Totals of whole subtrees from each node's own, by joining tries of doubling depth.

    ``totals`` (d, name, up, conv, n_leaves, saved). Where a block of depths is cut, the totals of
    the lower tries' roots go to their cut node, and the cut node's to the nodes above it in the upper trie.
    """
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved")]
    facts = totals.select("d", "name", "up", "conv")
    now, half = totals.select("d", "name", "up", "n_leaves", "saved"), 2
    while half <= deepest:
        lower = now.where((F.col("d") > 1) & (_low(F.col("d") - 1) == half)).groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("name")).agg(*sums)
        cut = now.where(_low(F.col("d")) == half).select("d", "name", "n_leaves", "saved").unionByName(lower).groupBy("d", "name").agg(*sums)
        cut = cut.join(facts.where(_low(F.col("d")) == half).select("d", "name", "conv"), ["d", "name"])
        cut = cut.select("conv", F.floor((F.col("d") - half) / half).alias("part"), F.col("d").alias("below"), "n_leaves", "saved")
        above = paths.withColumn("part", F.floor((F.col("d") - 1) / half)).join(cut, ["conv", "part"]).where("d < below")
        more = lower.unionByName(above.groupBy("d", "name").agg(*sums))
        now = now.unionByName(more, allowMissingColumns=True).groupBy("d", "name").agg(F.max("up").alias("up"), *sums)
        now = _kept(now, "grafted")
        half *= 2
    return now


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations' sequences of turns.

    ``turns`` (conv, d, digest, bytes) has the d-th turn of each conversation, d from 1 without gaps;
    ``conversations`` (conv, n) each conversation and its number of turns, 0 too. Ids are whole numbers, never
    null, and no conversation stands twice. Returns per node, the root of no turns included: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (the parent's conv_id; null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (of the subtree, itself
    included), ``saved_tokens`` (bytes that members but one share, over the subtree), ``ends_sha256`` (of the ids
    that end here) and ``name``. Without conversations there are no nodes.
    """
    deepest = conversations.agg(F.max("n")).first()[0]
    if deepest is None:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, name binary")
    paths = _kept(named(turns), "named")
    nodes = paths.groupBy("d", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up").alias("up"))
    nodes = _kept(nodes, "nodes")
    children = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = _kept(nodes.join(children, ["d", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    own = nodes.select("d", "name", "up", "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = _grafted(own, paths.select("conv", "d", "name"), deepest)
    first = totals.where("d = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).first()

    def number(x: int | None) -> Column:
        return F.lit(x or 0).cast("long")

    root = conversations.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).select(
        number(0).alias("d"), _root().alias("name"), "conv", "n_convs", F.lit(None).cast("binary").alias("up"),
        number(first["n_children"]).alias("n_children"), number(first["n_leaves"] or 1).alias("n_leaves"), number(first["saved"]).alias("saved"),
    )
    below = nodes.select("d", "name", "conv", "n_convs", "up", "n_children").join(totals.select("d", "name", "n_leaves", "saved"), ["d", "name"])
    all_nodes = _kept(root.unionByName(below), "trie")
    lasts = conversations.select("conv", F.col("n").alias("d"))
    lasts = paths.join(lasts, ["conv", "d"]).select("name", "conv").unionByName(lasts.where("d = 0").select(_root().alias("name"), "conv"))
    parents = all_nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("up"), F.col("conv").alias("parent_conv_id"))
    out = all_nodes.join(parents, ["d", "up"], "left").join(_ends(lasts), "name", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "name",
    )
