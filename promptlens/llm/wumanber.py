"""Benchmark items found in documents by multi-pattern search with block shift tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm import text as X
from promptlens.llm.graph import _kept

WINDOW = 10
BLOCK_BYTES = 8 << 20  # of patterns in a block: what the driver holds and broadcasts at once
PASS_BLOCKS = 8  # blocks that one pass over the documents searches for
TABLE_BITS = 20
STRIDE = 512  # bytes of text that each of the positions moving in step is responsible for

_STOP = 1  # stands between documents; 0 stands around words


@cache
def _folding() -> np.ndarray:
    """A-Z to lower case; 0 for bytes that belong to no word."""
    out = np.zeros(256, dtype=np.uint8)
    out[0x30:0x3A] = np.arange(0x30, 0x3A)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows with a zero before and after each; where each word's leading zero stands; its row."""
    low = _folding()[data]
    is_word = low > 0
    start, end, row = X.word_spans(is_word, offsets)
    rows = len(offsets) - 1
    sizes = end - start
    at = np.flatnonzero(is_word)
    word = np.repeat(np.arange(len(start)), sizes)
    out = np.zeros(len(at) + len(start) + 2 * rows, dtype=np.uint8)
    out[np.arange(len(at)) + word + 1 + 2 * row[word]] = low[at]
    words_to = np.searchsorted(row, np.arange(rows), side="right")
    bytes_to = np.concatenate(([0], np.cumsum(sizes)))[words_to]
    out[bytes_to + words_to + 2 * np.arange(1, rows + 1) - 1] = _STOP
    lead = np.concatenate(([0], np.cumsum(sizes)[:-1])) + np.arange(len(start)) + 2 * row if len(start) else start
    return out, lead, row


def _windows(window: int):
    """(pattern, words, item) of every window of an item: its words with a zero before and after each."""

    def windows(batches):
        for batch in batches:
            items = X.column(batch, "item")
            for first, last, data, offsets in X.pieces(X.column(batch, "text")):
                body, lead, row = folded(data, offsets)
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                patterns, words, at = [], [], []
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    n = min(window, b - a)
                    for i in range(a, b - n + 1 if n else a):
                        stop = lead[i + n] if i + n < b else lead[i + n - 1] + 1 + int(np.argmin(body[lead[i + n - 1] + 1 :] > _STOP))
                        patterns.append(body[lead[i] : stop + 1].tobytes())
                        words.append(n)
                        at.append(first + k)
                yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.binary()), pa.array(words, pa.int32()), items.take(pa.array(at, pa.int64()))], ["pattern", "words", "item"])

    return windows


class Block:
    """Patterns of a similar length, at least ``least`` bytes each, with their shift table and buckets."""

    def __init__(self, patterns: list[tuple[bytes, int, list]]):
        self.patterns = patterns
        self.least = min(len(p) for p, _, _ in patterns)
        self.width = min(6, self.least)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Table entry of the first ``width`` of eight bytes."""
        mask = np.uint64((1 << 8 * self.width) - 1)
        return ((words & mask) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    @cache
    def tables(self):
        m, b = self.least, self.width
        heads = np.frombuffer(b"".join(p[:m] for p, _, _ in self.patterns), np.uint8).reshape(-1, m)
        padded = np.concatenate((heads, np.zeros((len(heads), 8), np.uint8)), axis=1)
        shift = np.full(1 << TABLE_BITS, m - b + 1, dtype=np.int32)
        for q in range(m - b + 1):
            code = self.codes(np.ascontiguousarray(padded[:, q : q + 8]).view("<u8")[:, 0])
            shift[code] = np.minimum(shift[code], m - b - q)
        last = self.codes(np.ascontiguousarray(padded[:, m - b : m - b + 8]).view("<u8")[:, 0])
        order = np.argsort(last, kind="stable")
        first = np.ascontiguousarray(padded[:, :8]).view("<u8")[:, 0]
        keep = np.uint64((1 << 8 * min(8, m)) - 1)
        return shift, last[order], order, first & keep, keep

    def __reduce__(self):
        return Block, (self.patterns,)

    def search(self, body: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, number of the pattern) of every occurrence."""
        shift, buckets, order, firsts, keep = self.tables()
        m, b, n = self.least, self.width, len(body)
        if n < m:
            return
        padded = np.concatenate((body, np.zeros(8, np.uint8)))
        eight = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        at = np.arange(0, n - m + 1, STRIDE)  # where the pattern would start
        limit = np.minimum(at + STRIDE, n - m + 1)
        found = []
        while len(at):
            step = shift[self.codes(eight[at + m - b])]
            zero = step == 0
            found.append(at[zero])
            at = at + np.maximum(step, 1)
            alive = at < limit
            at, limit = at[alive], limit[alive]
        at = np.concatenate(found)
        at = at[body[at] == 0]  # patterns start at a word
        code = self.codes(eight[at + m - b])
        low, high = np.searchsorted(buckets, code), np.searchsorted(buckets, code, side="right")
        sizes = high - low
        at = np.repeat(at, sizes)
        which = order[np.repeat(low, sizes) + np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        alike = (eight[at] & keep) == firsts[which]
        text = body.tobytes()
        for place, number in zip(at[alike].tolist(), which[alike].tolist()):
            if text.startswith(self.patterns[number][0], place):
                yield place, number


def blocks(patterns: Iterator, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of patterns that come longest first; lengths within one differ by a factor of two at most."""
    held: list = []
    size = top = 0
    for row in patterns:
        pattern = bytes(row["pattern"])
        if held and (size + len(pattern) > block_bytes or 2 * len(pattern) < top):
            yield Block(held)
            held, size = [], 0
        if not held:
            top = len(pattern)
        if held and held[-1][0] == pattern:
            held[-1][2].append(row["item"])
        else:
            held.append((pattern, row["words"], [row["item"]]))
        size += len(pattern) + 8
    if held:
        yield Block(held)


def _scan(shared):
    def scan(batches):
        for batch in batches:
            hits, items, counts = [], [], []
            before = X.column(batch, "spans"), X.column(batch, "items")
            for first, last, data, offsets in X.pieces(X.column(batch, "text")):
                body, lead, row = folded(data, offsets)
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                spans: list[set] = [set(map(tuple, before[0][k].as_py() or [])) for k in range(first, last)]
                named: list[set] = [set(before[1][k].as_py() or []) for k in range(first, last)]
                for block in shared.value:
                    for place, number in block.search(body):
                        word = int(np.searchsorted(lead, place))
                        k = int(row[word])
                        _, n, own = block.patterns[number]
                        spans[k].add((word - int(cuts[k]), word - int(cuts[k]) + n))
                        named[k].update(own)
                counts.extend(np.diff(cuts).tolist())
                hits.extend([list(x) for x in sorted(s)] for s in spans)
                items.extend(sorted(s, key=lambda x: (x is None, x)) for s in named)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("spans", "items", "n_words")]
            names = [c for c in batch.schema.names if c not in ("spans", "items", "n_words")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.int64()))], [*names, "n_words", "spans", "items"]
            )

    return scan


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """Per document the spans of words that occur as a window of an item, and whose.

    Items are read in blocks of bounded size, longest windows first; a benchmark of more than
    ``PASS_BLOCKS`` blocks takes several passes, written in between. Returns id, text, ``n_words``, ``spans``
    (arrays of first word and word after the last) and ``items`` (sorted item ids), and with ``whole`` all
    columns of the input as struct ``row`` instead of the id.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    rows = source.mapInArrow(_windows(window), "pattern binary, words int, item long").distinct()
    rows = _kept(rows, "windows").orderBy(F.octet_length("pattern").desc(), "pattern", "item")
    key = F.struct("*").alias("row") if whole else F.col(id).alias("id")
    out = docs.select(key, F.col(text).alias("text"), F.lit(None).cast("array<array<long>>").alias("spans"), F.lit(None).cast("array<long>").alias("items"))
    schema = T.StructType([*out.schema.fields[:2], T.StructField("n_words", T.LongType()), *out.schema.fields[2:]])
    held: list[Block] = []
    passes = 0
    for block in blocks(rows.toLocalIterator(), block_bytes):
        held.append(block)
        if len(held) == PASS_BLOCKS:
            out = _kept(out.mapInArrow(_scan(spark.sparkContext.broadcast(held)), schema), "searched")
            held, passes = [], passes + 1
    if held or not passes:
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(held)), schema)
    return out.withColumnsRenamed({"id": id, "text": text})


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``contamination`` finds no occurrence in."""
    found = occurrences(docs, items, window, text=text, item=item, item_text=item_text, whole=True)
    return found.where(F.size("spans") == 0).select("row.*")


def _digest(batches):
    for batch in batches:
        hit, named, sha = [], [], []
        for spans, items in zip(X.column(batch, "spans").to_pylist(), X.column(batch, "items").to_pylist()):
            reach = total = 0
            for a, b in sorted(spans):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            ids = sorted(str(x) for x in items if x is not None)
            hit.append(total)
            named.append(len(ids))
            sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [X.column(batch, "id"), X.column(batch, "n_words"), pa.array(hit, pa.int64()), pa.array(named, pa.int64()), pa.array(sha, pa.string())],
            ["id", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document how much of it occurs in benchmark items.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters. A window is ``window``
    consecutive words of an item, or all of an item that has fewer, but some. Returns a row for each row:
    id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items`` (items with such
    windows), ``items_sha256`` (of their ids, sorted as strings, comma-joined) and ``contaminated``.

    A null text has no words; an item without id marks words but isn't counted or listed; items that
    repeat count once. Without items nothing is hit; an empty table gives an empty result. Other
    columns never matter.
    """
    found = occurrences(docs, items, window, id, text, item, item_text)
    kind = dict(found.dtypes)[id]
    rows = found.select(F.col(id).alias("id"), "n_words", "spans", "items")
    out = rows.mapInArrow(_digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id)
