"""Near-duplicate documents by one-permutation hashing, banded buckets and star-shaped candidates."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm import text as X
from promptlens.llm.graph import _kept, components
from promptlens.llm.lattice import keys

WORDS = 5
PERCENT = 80
BANDS = 40
ROWS = 6
BLOCK_SETS = 512  # documents of a cluster that are compared with as many others in one call
BLOCK_VALUES = 1 << 20  # and the set elements they may hold together, on average
CALLS = 1024  # groups that small clusters are dealt to at least; more where a group would hold more elements than a block

_EMPTY = np.uint64((1 << 64) - 1)


@cache
def _white() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def shingle_sets(texts: pa.Array, words: int):
    """(first row, sorted distinct shingle hashes of each row) for bounded runs of rows."""
    for first, last, data, offsets in X.pieces(texts):
        low = X.lower_ascii(data)
        start, end, row = X.word_spans(~_white()[low], offsets)
        h = keys(low, start, end)
        cuts = np.searchsorted(row, np.arange(last - first + 1))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = h[a:b]
            n = min(words, len(own))
            if n:
                joined = np.full(len(own) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    joined = X.mix(joined * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k])
                own = np.unique(joined)
            out.append(own)
        yield first, out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures: the least hash in each bin; an empty bin takes the value of the first
    bin that holds one in a fixed random sequence of its own."""
    out = np.full((len(sets), bins), _EMPTY, dtype=np.uint64)
    for i, own in enumerate(sets):
        if not len(own):
            continue
        own = np.sort(X.mix(own))
        at = ((own >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.append(True, at[1:] != at[:-1])
        out[i, at[first]] = own[first]
    held = out != _EMPTY
    row, col = np.nonzero(~held & held.any(axis=1)[:, None])
    turn = 0
    while len(row):
        turn += 1
        source = (X.mix(np.arange(bins, dtype=np.uint64) + np.uint64(turn * 65_537)) % np.uint64(bins)).astype(np.int64)[col]
        found = held[row, source]
        out[row[found], col[found]] = out[row[found], source[found]]
        row, col = row[~found], col[~found]
    return out


def _sign(words: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            ids = X.column(batch, "id")
            for first, sets in shingle_sets(X.column(batch, "text"), words):
                sig = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
                for k in range(rows):
                    key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
                with np.errstate(over="ignore"):
                    sums = np.array([(s.sum(dtype=np.uint64), X.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64)
                flat = pa.array(np.ascontiguousarray(key).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[:, 0].copy().view(np.int64)),
                        pa.array(sums[:, 1].copy().view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat),
                    ],
                    ["id", "n", "d1", "d2", "bands"],
                )

    return sign


def _sets(words: int):
    def sets(batches):
        for batch in batches:
            for first, rows in shingle_sets(X.column(batch, "text"), words):
                part = batch.slice(first, len(rows))
                kept = [X.column(part, c) for c in ("id", "cluster", "block", "blocks")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "cluster", "block", "blocks", "data"])

    return sets


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that are similar enough, without those that others already connect.

    ``side``: 0 for sets to compare with those of side 1 only; all of one value: with each other.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parent = np.arange(n)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flag = np.zeros(int(flat.max()) + 1 if len(flat) else 0, dtype=np.int64)
    mixed = side.min() != side.max()
    out = []
    for a in range(n - 1):
        if mixed and side[a] == 1:
            break
        low = int(np.searchsorted(side, 1)) if mixed else a + 1
        own = flat[starts[a] : starts[a] + sizes[a]]
        flag[own] = 1
        common = np.add.reduceat(flag[flat[starts[low] :]], starts[low:] - starts[low])
        flag[own] = 0
        for b in np.flatnonzero(100 * common >= percent * (sizes[a] + sizes[low:] - common)) + low:
            x, y = top(a), top(int(b))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, int(b)))
    return out


def _verify(percent: int):
    def verify(key, table):
        left, right = [], []
        table = table.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("id", "ascending")])
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        group = np.stack([table.column(c).to_numpy() for c in ("cluster", "i", "j")])
        edges = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))) if len(ids) else []
        data = table.column("data")
        for a, b in zip(edges, [*edges[1:], len(ids)]):
            at = [k for k in range(a, b) if k == a or ids[k] != ids[k - 1]]  # rows that repeat an id count once
            sets = [np.frombuffer(data[k].as_py(), dtype=np.uint64) for k in at]
            for x, y in linked(sets, side[at], percent):
                left.append(ids[at[x]])
                right.append(ids[at[y]])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return verify


def candidate_stars(classes: DataFrame) -> DataFrame:
    """For each bucket of a band a link from each document to the smallest one: as many as documents, not pairs."""
    rows = classes.select("rep", F.explode("bands").alias("key"))
    stars = rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    return rows.join(stars, "key").where("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Groups of documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more.

    Texts are lower-cased (A-Z) and cut at white space. Equal sets form a class first. Classes share
    a bucket when all hashes of a band agree; each bucket gives a star of candidates around
    its smallest document, and stars that touch form a cluster. Within a cluster every pair is
    confirmed on full sets (64-bit hashes of all shingles), block by block, so no link is lost that a
    star only hints at. At 80 percent similarity a pair shares a bucket with a probability of
    99.9995 percent (1 - (1 - 0.8**6)**40).

    Returns a row for each row: id, ``n_shingles``, ``component_id`` (the smallest id reachable over links)
    and ``kept`` (that id is its own). A text of fewer words than a shingle is one shingle; a text that is null,
    empty or white space has none and is linked with nothing. Rows without id take no part
    (``component_id`` null, kept). Rows that repeat an id share a component. An empty table gives
    an empty result; other columns never matter.
    """
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = _kept(base.mapInArrow(_sign(words, bands, rows), "id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    sets = ["d1", "d2", "n"]
    classes = signed.where("id is not null and n > 0").groupBy(*sets).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = _kept(classes, "classes")
    stars = components(candidate_stars(classes))
    nodes = stars.join(classes.select(F.col("rep").alias("id"), "n"), "id")
    shape = nodes.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("values"))
    calls = max(CALLS, -(-(shape.agg(F.sum("values")).first()[0] or 0) // BLOCK_VALUES))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SETS, F.col("values") / BLOCK_VALUES)).cast("int").alias("blocks")
    nodes = nodes.join(shape.select("component", blocks), "component")
    nodes = nodes.select("id", F.col("component").alias("cluster"), F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "blocks")
    wanted = base.where("id is not null").join(nodes, "id")
    full = wanted.mapInArrow(_sets(words), "id long, cluster long, block int, blocks int, data binary")
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    tasks = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("id", "cluster", i, j, F.when(F.col("block") == F.col("other"), 0).otherwise(F.when(F.col("block") < F.col("other"), 0).otherwise(1)).alias("side"), "blocks", "data")
    # small clusters share a call; the pairs of blocks of a large one have calls of their own
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(calls))).otherwise(F.xxhash64("cluster", "i", "j"))
    links = tasks.withColumn("deal", deal).groupBy("deal").applyInArrow(_verify(percent), "a long, b long")
    found = components(links)
    reps = signed.drop("bands").join(classes.drop("bands"), sets, "left")
    found = found.select(F.col("id").alias("rep"), "component")
    out = reps.join(found, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(component)
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
