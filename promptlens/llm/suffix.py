"""Removal of repeated byte strings by suffix arrays that are built shard by shard.

Two equal strings of ``LENGTH`` bytes have the same rarest ``SEED`` bytes (the seed of least
hash). Consecutive strings of a document with one seed form a run; runs go to shards by seed, so
equal strings always meet in one shard, whatever documents they stand in. Of runs that are equal
as a whole only the earliest is kept. Where a seed has runs that differ, their bytes are put
together and sorted by induced sorting, common prefixes come from the permuted array, and
neighbours that share ``LENGTH`` bytes are equal strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm import text as X
from promptlens.llm.payload import NO_ID, bucket, bucket_column, columns, pack, rows_of, unpack

LENGTH = 100
SEED = 24
SHARD_BYTES = 8 << 20  # of text that a shard answers for, on average
BUCKET_BYTES = 4 << 20  # of text that is cut at a time
SORTED_PARTS = 16  # a shard's seeds are sorted in so many parts, each an array of its own

ENTRY = np.dtype([("seed", "<u4"), ("own", "u1"), ("n", "<i4"), ("doc", "<i8"), ("at", "<i4"), ("run", "<u8")])
MARK = np.dtype([("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])


# ---------------------------------------------------------------- suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the last symbol is larger than the end)."""
    n = len(text)
    nxt = np.append(text[1:], -1).astype(np.int64)
    step = np.sign(nxt - text)  # 1: smaller than the next, 0: as the one to the right
    known = np.flatnonzero(step)
    return step[known[np.searchsorted(known, np.arange(n))]] > 0


def _deal(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by character, the sorted characters, each one's rank in its group, group sizes."""
    order = np.argsort(chars, kind="stable")
    ch = chars[order]
    edge = np.flatnonzero(np.append(True, ch[1:] != ch[:-1]))
    sizes = np.diff(np.append(edge, len(ch)))
    rank = np.arange(len(ch)) - np.repeat(edge, sizes)
    return order, ch, rank, sizes


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order of all suffixes from ordered leftmost-smaller ones, bucket by bucket in linear time."""
    n, k = len(text), len(counts)
    out = np.full(n, -1, dtype=np.int64)
    start = np.concatenate(([0], np.cumsum(counts)[:-1]))
    end = start + counts
    head, tail = start.copy(), end.copy()
    first = text[seeds]
    by_char = np.searchsorted(first, np.arange(k + 1)) if len(seeds) else np.zeros(k + 1, np.int64)

    def place(batch: np.ndarray, want: bool) -> None:
        before = batch[batch > 0] - 1
        before = before[smaller[before] == want]
        if not len(before):
            return
        order, ch, rank, sizes = _deal(text[before])
        if want:
            out[tail[ch] - 1 - rank] = before[order]
            tail[ch[rank == 0]] -= sizes
        else:
            out[head[ch] + rank] = before[order]
            head[ch[rank == 0]] += sizes

    out[head[text[n - 1]]] = n - 1  # the suffix before the end mark comes first in its bucket
    head[text[n - 1]] += 1
    for c in np.flatnonzero(counts):
        low = start[c]
        while low < head[c]:
            batch, low = out[low : head[c]], head[c]
            place(batch, False)
        place(seeds[by_char[c] : by_char[c + 1]], False)
    for c in np.flatnonzero(counts)[::-1]:
        high = end[c]
        while high > tail[c]:
            batch, high = out[tail[c] : high][::-1], tail[c]
            place(batch, True)
        place(out[start[c] : head[c]][::-1], True)
    return out


def _ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by their first ``depth`` names at least."""
    rank, width = names.astype(np.int64), 1
    while width < depth and len(rank):
        nxt = np.zeros(len(rank), dtype=np.int64)
        nxt[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        change = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = change
        width *= 2
        if change[-1] == len(key) - 1:
            break
    return rank


def suffix_array(text: np.ndarray, depth: int = 1 << 40) -> np.ndarray:
    """Suffixes of a text of small whole numbers, sorted by their first ``depth`` symbols at least.

    Suffixes are classed, the leftmost-smaller substrings are sorted by inducing from their own
    first symbols and named, their string of names is sorted the same way while its alphabet is
    small enough for buckets (by doubled ranks otherwise), and all suffixes are induced from it.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    counts = np.bincount(text)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        order = _induce(text, smaller, lms[np.argsort(text[lms], kind="stable")], counts)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        sums = X.prefix_sums((text & 0xFF).astype(np.uint8)) * np.uint64(3) + X.prefix_sums((text >> 8).astype(np.uint8)) if counts.size <= 1 << 16 else None
        stop = np.append(lms[1:] + 1, n)
        ends = np.empty(n, dtype=np.int64)
        ends[lms] = stop
        if sums is None:
            names = _ranks(text, depth)[lms]
            names = np.unique(names, return_inverse=True)[1]
        else:
            spans = X.span_hashes(sums, order, ends[order])
            whole = ends[order] == n  # runs into the end mark, so equals no other
            fresh = np.append(True, (spans[1:] != spans[:-1]) | whole[1:] | whole[:-1])
            name = np.empty(n, dtype=np.int64)
            name[order] = np.cumsum(fresh) - 1
            names = name[lms]
        top = int(names.max()) + 1
        if top < len(names):
            if top <= 256:
                lms = lms[suffix_array(names, depth)]
            else:
                lms = lms[np.argsort(_ranks(names, depth), kind="stable")]
        else:
            lms = lms[np.argsort(names, kind="stable")]
    return _induce(text, smaller, lms, counts)


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each text position the symbols that its suffix shares with the suffix before it in the order.

    Where that neighbour moves along with the position, the value is one less than its left
    neighbour's; only the other positions are compared, four symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, dtype=bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    follows[1:] &= text[:-1] == text[np.maximum(before[:-1], 0)]
    padded = np.concatenate((text.astype(np.int16), np.full(4, -2, np.int16)))
    four = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(2,))
    todo = np.flatnonzero(~follows & (before >= 0))
    depth = np.zeros(len(todo), dtype=np.int64)
    alive = np.arange(len(todo))
    while len(alive):
        i, j = todo[alive] + depth[alive], before[todo[alive]] + depth[alive]
        alive = alive[four[i] == four[j]]
        depth[alive] += 4
    alive = np.arange(len(todo))
    while len(alive):
        i, j = todo[alive] + depth[alive], before[todo[alive]] + depth[alive]
        alive = alive[padded[i] == padded[j]]
        depth[alive] += 1
    length = np.zeros(n, dtype=np.int64)
    length[todo] = depth
    anchor = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(length[anchor] - (at - anchor), 0)


# ---------------------------------------------------------------- runs of a document


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Runs of strings with one seed: first string, strings, seed hash, whether the seed stands there more than once,
    the run's hash, and the row."""
    n, w = len(data), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(bool), none.astype(np.uint64), none
    sums = X.prefix_sums(data)
    at = np.arange(n - seed + 1)
    h = X.span_hashes(sums, at, at + seed)
    bits = np.uint64(max(24, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best, k = (h & ~low) | at.astype(np.uint64), 1
    while 2 * k <= w:
        best, k = np.minimum(best[:-k], best[k:]), 2 * k
    if k < w:
        best = np.minimum(best[: len(best) - (w - k)], best[w - k :])
    where = (best & low).astype(np.int64)
    m = len(where)
    row_end = np.repeat(offsets[1:], np.diff(offsets))[:m]
    whole = at[:m] + length <= row_end
    value = h[where]
    fresh = np.append(True, (value[1:] != value[:-1]) | ~whole[:-1]) & whole
    starts = np.flatnonzero(fresh)
    stop = np.append(fresh | ~whole, True)
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    moved = np.append(0, np.cumsum(where[1:] != where[:-1]))
    own = moved[ends - 1] > moved[starts]
    run = X.span_hashes(sums, starts, ends + length - 1)
    return starts, ends - starts, value[starts], own, run, np.searchsorted(offsets, starts, side="right") - 1


def _forward(docs: np.ndarray, at: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Marks on their way to the bucket of their document: keys below zero."""
    rows = np.empty(len(docs), dtype=MARK)
    rows["doc"], rows["at"], rows["n"] = docs, at, n
    return pack(-1 - bucket(rows["doc"], buckets), rows)


def _first_of(keys: list[np.ndarray], docs: np.ndarray, at: np.ndarray):
    """Order by keys, document and place; the start of each group; whether a row repeats its group's first place."""
    order = np.lexsort((at, docs, *keys[::-1]))
    change = np.zeros(len(order), dtype=bool)
    if len(order):
        change[0] = True
        for key in keys:
            change[1:] |= key[order][1:] != key[order][:-1]
    group = np.cumsum(change) - 1
    first = np.flatnonzero(change)
    lead = order[first][group] if len(order) else order
    same = (docs[order] == docs[lead]) & (at[order] == at[lead])
    return order, change, group, same


def _entries(length: int, seed: int, shards: int, buckets: int):
    def scan(batches):
        for batch in batches:
            ids = pc.fill_null(X.column(batch, "id"), NO_ID).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in X.pieces(X.column(batch, "text")):
                starts, n, value, own, run, row = _runs(data, offsets, length, seed)
                if not len(starts):
                    continue
                docs, at = ids[a + row], starts - offsets[row]
                # runs that repeat within this piece go on as marks, so that a common run costs one entry
                order, change, _, same = _first_of([run, n], docs, at)
                keep, drop = order[change], order[~change & ~same]
                rows = np.empty(len(keep), dtype=ENTRY)
                rows["seed"], rows["own"], rows["n"] = value[keep] >> np.uint64(32), own[keep], n[keep]
                rows["doc"], rows["at"], rows["run"] = docs[keep], at[keep], run[keep]
                yield pack((value[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64) % shards, rows)
                if len(drop):
                    yield _forward(docs[drop], at[drop], n[drop], buckets)

    return scan


def _answer(buckets: int):
    def answer(key, table):
        """Of equal runs all but the earliest are marked; seeds with differing runs are asked for their bytes."""
        shard = key[0].as_py()
        if shard < 0:
            return pa.table({"k": pa.array([-1 - shard] * len(table), pa.int64()), "ask": pa.array([-1] * len(table), pa.int64()), "data": table.column("data").cast(pa.binary())})
        rows = unpack(table, ENTRY)
        order, change, _, same = _first_of([rows["seed"], rows["run"], rows["n"]], rows["doc"], rows["at"])
        lead = order[change]
        drop = order[~change & ~same]
        heads = rows[lead]
        spellings = np.bincount(np.unique(heads["seed"], return_inverse=True)[1]) if len(heads) else np.zeros(0, np.int64)
        many = spellings[np.unique(heads["seed"], return_inverse=True)[1]] > 1 if len(heads) else np.zeros(0, bool)
        ask = heads[many | (heads["own"] > 0)]
        part = ask["seed"] % np.uint32(SORTED_PARTS)
        parts = [(ask[part == p], shard * SORTED_PARTS + p) for p in range(SORTED_PARTS)]
        out = []
        for picked, kind in ((rows[drop], -1), *parts):
            if len(picked):
                batch = _forward(picked["doc"], picked["at"], picked["n"], buckets)
                out.append(pa.table({"k": pc.subtract(-1, batch.column(0)), "ask": pa.array([kind] * batch.num_rows, pa.int64()), "data": batch.column(1)}))
        return pa.concat_tables(out) if out else pa.table({"k": pa.array([], pa.int64()), "ask": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})

    return answer


def _cut(length: int):
    def cut(key, docs, asks):
        """The bytes of the runs that were asked for; marks pass."""
        out_k, out_d = [], []
        ids = pc.fill_null(docs.column("id"), NO_ID).to_numpy()
        texts = docs.column("text").cast(pa.large_binary())
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        for shard, data in zip(asks.column("ask").to_pylist(), asks.column("data").to_pylist()):
            if shard < 0:
                out_k.append(-1 - key[0].as_py())
                out_d.append(data)
                continue
            rows = rows_of(data, MARK)
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            found = np.searchsorted(ids, rows["doc"])
            parts, last, body = [], -1, b""
            for r, f in zip(rows, found):
                if f != last:
                    body, last = texts[int(order[f])].as_py() or b"", f
                parts.append(body[r["at"] : r["at"] + r["n"] + length - 1])
            out_k.append(shard)
            out_d.append(len(rows).to_bytes(8, "little") + columns(rows) + b"".join(parts))
        return pa.table({"k": pa.array(out_k, pa.int64()), "data": pa.array(out_d, pa.binary())})

    return cut


def _sort(length: int, buckets: int):
    def sort(key, table):
        shard = key[0].as_py()
        if shard < 0:
            return pa.table({"k": pa.array([-1 - shard] * len(table), pa.int64()), "data": table.column("data").cast(pa.binary())})
        rows, bodies = [], []
        for data in table.column("data").to_pylist():
            n = int.from_bytes(data[:8], "little")
            rows.append(rows_of(data[8 : 8 + n * MARK.itemsize], MARK))
            bodies.append(data[8 + n * MARK.itemsize :])
        batch = _forward(*repeated(np.concatenate(rows), np.frombuffer(b"".join(bodies), np.uint8), length), buckets)
        return pa.table({"k": pc.subtract(-1, batch.column(0)), "data": batch.column(1)})

    return sort


def repeated(rows: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings within the given runs, those that also start earlier: document, first place, number in a row."""
    sizes = rows["n"].astype(np.int64) + length - 1
    text = np.zeros(len(body) + len(rows), dtype=np.int16)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(body)) + row  # one separator after each run
    text[place] = body.astype(np.int16) + 1
    inner = np.arange(len(body)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = suffix_array(text, length)
    shared = permuted_lcp(text, order)
    whole = np.zeros(len(text), dtype=bool)
    whole[place] = inner < sizes[row] - length + 1
    doc = np.unique(rows["doc"], return_inverse=True)[1]
    rank = np.zeros(len(text), dtype=np.int64)
    rank[place] = (doc[row] << 32) + rows["at"][row] + inner
    order = order[whole[order]]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    # strings that are not whole sort between whole ones only where those differ
    fresh = shared[order] < length
    fresh[0] = True
    edges = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(rank[order], edges), np.diff(np.append(edges, len(order))))
    hit = np.zeros(len(text), dtype=bool)
    hit[order] = rank[order] != least
    start = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
    end = np.flatnonzero(hit & ~np.append(hit[1:], False)) + 1
    back = np.zeros(len(text), dtype=np.int64)
    back[place] = np.arange(len(body))
    r = row[back[start]]
    return rows["doc"][r], rows["at"][r] + inner[back[start]], end - start


def covered(marks: np.ndarray, size: int, length: int) -> np.ndarray:
    """Spans of bytes that marked strings cover, merged: an array of (start, end)."""
    start = np.minimum(marks["at"].astype(np.int64), size)
    end = np.minimum(start + marks["n"] + length - 1, size)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], axis=1)


def _whole_characters(body: bytes, spans: np.ndarray) -> str:
    """The text without the characters all of whose bytes are removed."""
    data = np.frombuffer(body, np.uint8)
    gone = np.zeros(len(data) + 1, dtype=np.int64)
    gone[spans[:, 0]] += 1
    gone[spans[:, 1]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return ""
    stays = np.logical_or.reduceat(~gone, lead)
    return data[np.repeat(stays, np.diff(np.append(lead, len(data))))].tobytes().decode("utf-8", "replace")


def _finish(length: int, with_text: bool, rest: bool):
    def finish(key, docs, marks):
        ids = docs.column("id")
        rows = unpack(marks, MARK)
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        known = pc.fill_null(ids, NO_ID).to_numpy()
        lows, highs = np.searchsorted(rows["doc"], known), np.searchsorted(rows["doc"], known, side="right")
        for i, value in enumerate(docs.column("text").cast(pa.large_binary())):
            body = value.as_py() or b""
            own = rows[lows[i] : highs[i]]
            spans = covered(own, len(body), length) if len(own) else np.zeros((0, 2), np.int64)
            edges = [0, *spans.ravel().tolist(), len(body)]
            left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            n_bytes.append(len(body))
            n_removed.append(len(body) - len(left))
            n_spans.append(len(spans))
            sha.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept.append(_whole_characters(body, spans) if len(own) else value.as_py() and body.decode("utf-8", "replace"))
        out = {"id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            out["kept"] = pa.array(kept, pa.string())
        if rest:
            out["rest"] = docs.column("rest")
        return pa.table(out)

    return finish


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Per document what is left when each byte of a ``length``-byte string that also starts earlier goes.

    Earlier means in a document of smaller id, or further left in the same one; strings are judged
    on the input, may overlap, and never cross documents. Returns the id, ``n_bytes``, ``n_removed``,
    ``n_spans`` and ``kept_sha256``; with ``keep_text`` also ``kept`` (the text without the characters
    that lost all their bytes) and the other columns as struct ``rest``.

    A null text has no bytes and hashes as empty (``kept`` stays null); a null id counts as smaller
    than any other; rows that share an id are taken as repeats of one document, so neither is
    earlier than the other; an empty table gives an empty result. Other columns never matter.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(8, total // SHARD_BYTES + 1)
    buckets = max(8, total // BUCKET_BYTES + 1)
    rest = [c for c in docs.columns if c not in (id, text)] if keep_text else []
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    pairs = "k long, data binary"
    entries = base.select("id", "text").mapInArrow(_entries(length, seed, shards, buckets), pairs)
    answers = entries.groupBy("k").applyInArrow(_answer(buckets), "k long, ask long, data binary")

    dealt = base.withColumn("k", bucket_column(F.coalesce("id", F.lit(NO_ID)), buckets)).repartition("k")
    strings = dealt.groupBy("k").cogroup(answers.groupBy("k")).applyInArrow(_cut(length), pairs)
    marks = strings.groupBy("k").applyInArrow(_sort(length, buckets), pairs)
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    if keep_text:
        schema = schema.add("kept", T.StringType())
    if rest:
        schema = schema.add(base.schema["rest"])
    out = dealt.groupBy("k").cogroup(marks.groupBy("k")).applyInArrow(_finish(length, keep_text, bool(rest)), schema)
    return out.withColumnRenamed("id", id)
