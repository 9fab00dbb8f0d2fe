"""Nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptlens.llm import text as X
from promptlens.llm.graph import _kept

TREES = 16
BITS = 64  # of a tree's hash strings
#: Queries of a bounded, fixed sample that set how many rows a query must reach, and the share of their true
#: neighbours that must be among those. All rows are indexed.
SAMPLE = 128
AIM = 0.97
STEP = 4  # levels by which queries that reach too few rows ascend from one round to the next
BLOCK_ROWS = 16_384  # rows of a subtree that one task holds as a sorted array


def planes(dim: int, trees: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * BITS))


def hash_strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """A string of ``BITS`` signs per row and tree, first bit highest, as unsigned numbers."""
    signs = (vectors @ planes(vectors.shape[1], trees) >= 0).reshape(len(vectors), trees, BITS)
    packed = np.packbits(signs, axis=2)
    return np.ascontiguousarray(packed).view(">u8")[:, :, 0].astype(np.uint64)


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has only finite components and isn't zero, and those vectors (of one length each)."""
    lists = column.cast(pa.list_(pa.float64()))
    rows, out = [], []
    for k, value in enumerate(lists):
        if value.is_valid:
            own = value.values.to_numpy(zero_copy_only=False)  # nulls within become nan
            if len(own) and np.isfinite(own).all() and own.any():
                rows.append(k)
                out.append(own)
    return np.array(rows, dtype=np.int64), out


def _clean(batches):
    """Usable vectors as bytes of doubles, with their number of components."""
    for batch in batches:
        rows, vectors = _usable(X.column(batch, "vector"))
        yield pa.RecordBatch.from_arrays(
            [X.column(batch, "id").take(pa.array(rows)), pa.array([len(v) for v in vectors], pa.int32()), pa.array([(v + 0.0).astype("<f8").tobytes() for v in vectors], pa.binary())],
            ["id", "dim", "data"],
        )


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits the strings share before they differ."""
    differ = a ^ b
    high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def longest(strings: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Descent: bits that each query shares with its longest match, one of the two strings it falls between."""
    at = np.searchsorted(strings, wanted)
    before, after = strings[np.maximum(at - 1, 0)], strings[np.minimum(at, len(strings) - 1)]
    return np.maximum(shared_bits(before, wanted), shared_bits(after, wanted))


def spans(strings: np.ndarray, wanted: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted strings that share the first ``level`` bits with each query begin and end."""
    rest = np.uint64(2**BITS - 1) >> np.broadcast_to(np.asarray(level).astype(np.uint64), wanted.shape)  # none at 64
    return np.searchsorted(strings, wanted & ~rest), np.searchsorted(strings, wanted | rest, side="right")


def ascent(strings: np.ndarray, wanted: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, level, rows in reach) of each level from a query's longest match up to ``floor``."""
    none = np.zeros(0, np.int64)
    out: tuple[list, list, list] = ([none], [none], [none])
    if len(strings) and len(wanted):
        match = longest(strings, wanted)
        for level in range(int(match.max()), floor - 1, -1):
            who = np.flatnonzero(match >= level)
            low, high = spans(strings, wanted[who], level)
            for have, new in zip(out, (who, np.full(len(who), level), high - low)):
                have.append(new)
    return tuple(np.concatenate(x) for x in out)


def _measure(shared, top: int, trees: int):
    """For the sampled queries: the nearest rows of a batch with the longest prefix they share in any tree, and
    how many rows all trees together reach at each level (these rows have no score)."""

    def measure(batches):
        ids, queries = shared.value
        own = hash_strings(queries, trees)
        for batch in batches:
            known = X.column(batch, "id").to_numpy()
            data = _matrix(X.column(batch, "data"))
            if not len(known):
                continue
            strings = hash_strings(data, trees)
            reach = np.zeros((len(queries), BITS + 1), np.int64)
            for tree in range(trees):
                who, level, n = ascent(np.sort(strings[:, tree]), own[:, tree], 0)
                reach[who, level] += n
            who, level = np.nonzero(reach)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[who]), pa.nulls(len(who), pa.float64()), pa.array(level), pa.array(reach[who, level])], ["query", "score", "level", "n"]
            )
            score = queries @ data.T
            for q in range(len(queries)):
                near = np.argpartition(-score[q], min(top, len(known) - 1))[: top + 1]
                near = near[known[near] != ids[q]]
                same = shared_bits(strings[near], own[q]).max(axis=1, initial=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(near), ids[q])), pa.array(score[q][near]), pa.array(same), pa.array(np.ones(len(near), np.int64))], ["query", "score", "level", "n"]
                )

    return measure


def calibrate(vectors: DataFrame, queries: DataFrame, top: int, trees: int = TREES, least: int | None = None, sample: int = SAMPLE, aim: float = AIM) -> tuple[int, int]:
    """(rows that a query must reach over all trees, a level that most queries needn't ascend beyond).

    Measured on at most ``sample`` queries against all rows. A neighbour that shares k bits in some tree is reached
    if the query must reach more rows than those that share k + 1 bits, so a quantile of their numbers gives
    ``aim`` of the true neighbours. Never fewer than make one tree reach ``top`` rows beside the query.
    """
    enough = trees * (top + 1)
    spark = vectors.sparkSession
    picked = queries.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not picked:
        return max(enough, least or 0), 0
    ids = np.array([r["id"] for r in picked])
    shared = spark.sparkContext.broadcast((ids, np.frombuffer(b"".join(r["data"] for r in picked), "<f8").reshape(len(picked), -1)))
    seen = _kept(vectors.select("id", "data").mapInArrow(_measure(shared, top, trees), "query long, score double, level long, n long"), "sampled")
    place = {q: k for k, q in enumerate(ids.tolist())}
    reach = np.zeros((len(ids), BITS + 2), np.int64)
    for r in seen.where("score is null").groupBy("query", "level").agg(F.sum("n").alias("n")).collect():
        reach[place[r["query"]], r["level"]] = r["n"]
    ranked = seen.where("score is not null").withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("rank") <= top)
    near = ranked.select("query", "level").collect()
    if least is None and near:
        needed = np.sort([reach[place[r["query"]], r["level"] + 1] + 1 for r in near])
        least = int(needed[min(len(needed) - 1, int(aim * len(needed)))])
    least = max(enough, least or 0)
    stops = [max((level for level in range(BITS + 1) if own[level] >= least), default=0) for own in reach]
    return least, int(np.quantile(stops, 0.1))


def _plant(trees: int, floor: int, columns: list[str]):
    """Each row's hash string in every tree, with the subtree it falls into at ``floor``."""

    def plant(batches):
        for batch in batches:
            data = _matrix(X.column(batch, "data"))
            if not len(data):
                continue
            flat = hash_strings(data, trees).ravel()
            n = len(data)
            subtree = (flat >> np.uint64(BITS - floor)).astype(np.int64) if floor else np.zeros(n * trees, np.int64)
            tree = np.tile(np.arange(trees, dtype=np.int32), n)
            part = batch.select(columns).take(pa.array(np.repeat(np.arange(n), trees)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tree), pa.array(subtree), pa.array(flat.view(np.int64))], [*columns, "tree", "subtree", "string"])

    return plant


def _count(floor: int):
    def count(key, members, queries):
        """How many rows of the sorted array each query reaches at each level."""
        strings = np.sort(members.column("string").to_numpy().view(np.uint64))
        who, level, n = ascent(strings, queries.column("string").to_numpy().view(np.uint64), floor)
        return pa.table([queries.column("id").combine_chunks().take(pa.array(who)), pa.array(level.astype(np.int32)), pa.array(n)], names=["id", "level", "n"])

    return count


def _search(top: int):
    def search(key, members, queries):
        """The best of the rows that each query reaches in the sorted array at the level it stops at."""
        strings = members.column("string").to_numpy().view(np.uint64)
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        data, own = _matrix(members.column("data"))[order], members.column("id").to_numpy()[order]
        asked = queries.column("id").to_numpy()
        targets, wanted = _matrix(queries.column("data")), queries.column("string").to_numpy().view(np.uint64)
        low, high = spans(strings, wanted, queries.column("stop").to_numpy())
        found: list[list] = [[], [], []]
        for q in np.flatnonzero(high > low):
            a, b = low[q], high[q]
            score = data[a:b] @ targets[q]
            n = min(top + 1, b - a)
            best = np.argpartition(-score, n - 1)[:n] if n < b - a else np.arange(b - a)
            # rows that tie with the last one kept are kept as well
            best = np.flatnonzero(score >= score[best].min()) if n < b - a else best
            exact = (data[a:b][best] * targets[q]).sum(axis=1)
            found[0].append(np.full(len(best), asked[q]))
            found[1].append(own[a:b][best])
            found[2].append(exact)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "rep", "score"])

    return search


def _round(members: DataFrame, asked: DataFrame, top: int, trees: int, floor: int, least: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Queries that reach ``least`` rows without ascending beyond ``floor``, each with the level it stops at, and
    (query, rep, score) of the best rows they reach. At the root all queries stop."""
    keys = ["tree", "subtree"]

    def planted(rows, columns):
        kinds = dict(rows.dtypes)
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "tree int, subtree long, string long"])
        return rows.select("id", "data", *(c for c in columns if c not in ("id", "data"))).mapInArrow(_plant(trees, floor, columns), schema)

    # how many sorted arrays each subtree needs that a query falls into
    visited = planted(asked, ["id"]).select(*keys).distinct()
    sizes = planted(members, ["id"]).groupBy(*keys).agg(F.count("*").alias("n")).join(visited, keys, "left_semi")
    parts = _kept(sizes.select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("parts")), "subtrees")

    def dealt(columns):
        rows = planted(members, columns).join(parts, keys)
        return rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts").groupBy(*keys, "part")

    def sent(rows, columns):
        rows = planted(rows, columns).join(parts, keys)
        return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").groupBy(*keys, "part")

    counts = dealt(["id"]).cogroup(sent(asked, ["id"])).applyInArrow(_count(floor), "id long, level int, n long")
    reached = counts.groupBy("id", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    stops = reached.groupBy("id").agg(F.max("level").alias("stop"))
    settled = asked.join(stops, "id", "inner" if floor else "left").withColumn("stop", F.coalesce("stop", F.lit(0)))
    settled = _kept(settled, "settled")
    found = dealt(["id", "data"]).cogroup(sent(settled, ["id", "data", "stop"])).applyInArrow(_search(top), "query long, rep long, score double")
    return settled, _kept(found.groupBy("query", "rep").agg(F.max("score").alias("score")), "found")


def neighbours(
    table: DataFrame, is_query, top: int = 20, id: str = "vec_id", vector: str = "embedding", trees: int = TREES, least: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``top`` nearest rows by inner product of each query row, among those that the forest reaches.

    ``is_query`` is a condition on the id; candidates are all rows but the query itself. Each tree turns a
    vector into a long string of signs of random projections and sorts all rows by it. A query descends in every
    tree to its longest matching prefix; then all trees ascend together, bit by bit, until they hold ``least``
    rows between them that share so long a prefix with the query. Those are its candidates, scored in double precision. So a
    query in a dense region stops at a long prefix and one in a sparse region at a short one. ``least`` comes from a
    bounded sample of queries (``calibrate``) if it isn't given, and is raised to what makes ``top`` rows certain.

    The sorted arrays are those of subtrees. A first round settles the queries that needn't leave their subtrees;
    the others go on in subtrees ``STEP`` levels higher, the last of them at the root. Subtrees of more than
    ``block_rows`` rows are split into several sorted arrays, which each query visits, so no task
    grows with a dense region. Equal vectors are indexed once with their ``top`` + 1 smallest ids, which
    are all that can be among a query's nearest.

    Returns ``query_id``, ``rank`` (from 1), id and ``score``, nearest first, ties to the smaller id. Rows
    with a null id or a vector that is null, empty, zero or holds null or non-finite components take no part;
    vectors of another length than the most common one neither. Rows that repeat an id count once per
    distinct vector. An empty table gives an empty result.
    """
    base = table.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
    rows = base.mapInArrow(_clean, "id long, dim int, data binary")
    rows = _kept(rows, "vectors")
    dim = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if dim is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id), F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.col("dim") == dim["dim"]).select("id", "data")
    asks = rows.where(is_query(F.col("id")))
    # equal vectors: one representative, and the few smallest ids of each
    shapes = rows.groupBy("data").agg(F.min("id").alias("id"))
    order = W.partitionBy("data").orderBy("id")
    copies = rows.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= top + 1)
    ids = copies.join(shapes.withColumnRenamed("id", "rep"), "data").select("rep", "id")
    members = _kept(shapes, "members")
    queries = _kept(asks.groupBy("data").agg(F.min("id").alias("id")), "queries")
    least, floor = calibrate(members, queries, top, trees, least)
    floor = min(floor, int(np.log2(max(1, 4 * members.count() / block_rows))))  # no smaller subtrees than a task is worth
    asked, found = queries, None
    while True:
        settled, more = _round(members, asked, top, trees, floor, least, block_rows)
        found = more if found is None else found.union(more)
        if not floor:
            break
        asked = _kept(asked.join(settled, "id", "left_anti"), "unsatisfied")
        if asked.isEmpty():
            break
        floor = max(0, floor - STEP)
    # a representative's copies only add rows, so rows beyond the first classes can't matter
    found = found.withColumn("at", F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("at") <= top + 1).drop("at")
    same = queries.select(F.col("id").alias("query"), "data").join(asks.withColumnRenamed("id", "query_id"), "data").select("query", "query_id").distinct()
    out = found.join(ids, "rep").join(same, "query").where("id != query_id")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.select("query_id", "id", "score").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    return out.select("query_id", "rank", F.col("id").alias(id), "score")
