"""Probability of whole texts over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.llm import text as X
from promptlens.llm.graph import _kept

#: A word that makes up one part in so many of all words, or more, is looked up in every task; there are no more
#: such words than this. All others are joined.
FREQUENT = 1 << 18
#: Rounds in which the weights of the pieces are learned.
ROUNDS = 2
#: How many pieces' worth of evidence the vocabulary's own scores are.
PRIOR = 1000.0
#: Bytes of text whose distinct words are counted at once.
COUNTED_BYTES = 2 << 20
#: Bytes of words that one step works on, and from where on a word counts as long.
FLAT, LONG = 1 << 18, 48

#: Stands for the space before a word: no byte of UTF-8.
_SPACE = b"\xff"


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(child of each node and byte, piece that ends at each node or -1, prior of each piece, id of the end).

    The pieces of a sentencepiece model as a trie of bytes. Each byte has its own piece, so every text has a segmentation.
    Scores of merge models fall by one from piece to piece: they rank pieces, and weigh them 1 / (2 - score).
    Control, unknown and unused pieces, and those with a space elsewhere than in front, take no part.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces, prior = {}, np.zeros(size)
    for i in range(size):
        body, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            key, score = bytes([int(body[3:5], 16)]), -size
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        else:
            key = (_SPACE + body[1:].encode()) if body.startswith("▁") else body.encode()
            if "▁" in body[1:]:
                continue
        if key in pieces:  # a byte's own piece beside the character's: one of them is enough
            score = max(score, -1 / prior[pieces[key]] + 2)
        else:
            pieces[key] = i
        prior[pieces[key]] = 1 / (2 - score)
    end = model.eos_id()
    prior[end] = 1e-3
    prefixes = sorted({key[:n] for key in pieces for n in range(1, len(key) + 1)}, key=len)
    node = {b"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
    child = np.zeros((len(node), 256), dtype=np.int32)
    ends = np.full(len(node), -1, dtype=np.int32)
    for p in prefixes:
        child[node[p[:-1]], p[-1]] = node[p]
        ends[node[p]] = pieces.get(p, -1)
    return child, ends, prior / prior.sum(), end


def _arcs(data: np.ndarray, stop: np.ndarray, low: int, high: int, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, piece) of every occurrence of a piece that begins in data[low:high]; stop is each byte's word's end."""
    child, ends, _, _ = vocabulary(path)
    at = np.arange(low, high)
    node, begin, found = np.zeros(high - low, dtype=np.int32), at, []
    while len(at):
        node = child[node, data[at]]
        live = node > 0
        node, begin, at = node[live], begin[live], at[live] + 1
        piece = ends[node]
        hit = piece >= 0
        found.append((begin[hit], at[hit], piece[hit]))
        live = at < stop[begin]
        node, begin, at = node[live], begin[live], at[live]
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _steps(key: np.ndarray) -> Iterator[slice]:
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(key))):
        yield slice(a, b)


def forward_backward(data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, path: str, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of each word's probability, summed over its segmentations; and, where words are
    counted, how often each piece is expected in them.

    ``data`` holds the words one after another, each led by _SPACE; ``weight`` the pieces' log weights. In log
    space a place's sum is complete when all arcs that begin before it are added; all words go in step, and one
    of more than FLAT bytes in parts.
    """
    words = len(offsets) - 1
    length = np.diff(offsets)
    # a place more than bytes for each word
    shift = np.arange(words)
    word = np.repeat(shift, length)
    stop = np.repeat(offsets[1:], length)
    place = np.arange(len(data)) + word
    alpha = np.full(len(data) + words, -np.inf)
    first, last = offsets[:-1] + shift, offsets[1:] + shift
    alpha[first] = 0
    parts = [(a, min(a + FLAT, len(data))) for a in range(0, len(data), FLAT)] if words == 1 else [(0, len(data))]
    for low, high in parts:
        begin, to, piece = _arcs(data, stop, low, high, path)
        step = begin - offsets[word[begin]]
        order = np.argsort(step, kind="stable")
        source, target, w = place[begin][order], (to + word[begin])[order], weight[piece][order]
        for s in _steps(step[order]):
            alpha[target[s]] = np.logaddexp(alpha[target[s]], alpha[source[s]] + w[s])
    total = alpha[last]
    if counts is None:
        return total, None
    beta = np.full(len(alpha), -np.inf)
    beta[last] = 0
    expected = np.zeros(len(weight))
    for low, high in reversed(parts):
        begin, to, piece = _arcs(data, stop, low, high, path)
        step = to - offsets[word[begin]]
        order = np.argsort(-step, kind="stable")
        source, target, w = place[begin][order], (to + word[begin])[order], weight[piece][order]
        for s in _steps(step[order]):
            beta[source[s]] = np.logaddexp(beta[source[s]], beta[target[s]] + w[s])
        own = word[begin][order]
        share = np.exp(alpha[source] + w + beta[target] - total[own]) * counts[own]
        expected += np.bincount(piece[order], share, minlength=len(weight))
    return total, expected


def _batched(batches: Iterator[pa.RecordBatch], number: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets, numbers, words) of words of alike length, each led by _SPACE."""
    held: list[tuple[bytes, int]] = []
    size = 0

    def flat(words: list[bytes], numbers: list[int]):
        data = np.frombuffer(_SPACE + _SPACE.join(words), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
        return data, offsets, np.array(numbers, dtype=np.int64), pa.array(words, pa.binary())

    def longer():
        held.sort(key=lambda x: len(x[0]))
        group, n = [], 0
        for x in held:
            if group and n + len(x[0]) > FLAT:
                yield flat(*map(list, zip(*group)))
                group, n = [], 0
            group.append(x)
            n += len(x[0])
        if group:
            yield flat(*map(list, zip(*group)))
        held.clear()

    for batch in batches:
        words, numbers = X.column(batch, "word").to_pylist(), X.column(batch, number).to_pylist()
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                held.append((w, numbers[i]))
                size += len(w)
        if short:
            yield flat([words[i] for i in short], [numbers[i] for i in short])
        if size > 4 * FLAT:
            yield from longer()
            size = 0
    yield from longer()


def _learn(words: DataFrame, path: str, ends: int) -> np.ndarray:
    """Weights (natural logarithms) of the pieces: the vocabulary's own scores, then rounds of expected counts.

    ``words`` (word, n) holds every distinct training word. Only one number for each piece reaches the driver.
    """
    _, _, prior, end = vocabulary(path)
    weight = np.log(np.maximum(prior, 1e-300))
    for _ in range(ROUNDS):

        def expect(batches: Iterator[pa.RecordBatch], weight: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weight))
            for data, offsets, n, _ in _batched(batches, "n"):
                total += forward_backward(data, offsets, weight, path, n)[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "expected"])

        counts = PRIOR * prior
        counts[end] += ends
        for r in words.mapInArrow(expect, "piece long, expected double").groupBy("piece").agg(F.sum("expected").alias("n")).collect():
            counts[r["piece"]] += r["n"]
        weight = np.log(np.maximum(counts / counts.sum(), 1e-300))
    return weight


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, eight bytes at a time through a mixer that isn't linear."""
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = X.mix((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    left, at, some = end - start, start, np.arange(len(start))
    while len(some):
        value = eight[at]
        short = left < 8
        value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[some] = X.mix(out[some] + value * np.uint64(0xD1342543DE82EF95))
        go = left > 8
        some, at, left = some[go], at[go] + 8, left[go] - 8
    return out


def _taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans' bytes as one array of values."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    body = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())


def _words(texts: pa.Array) -> Iterator[tuple]:
    """(first row, last row, lower-case bytes, start, end, row, hash) of the words of bounded runs of rows."""
    for first, last, data, offsets in X.pieces(texts, COUNTED_BYTES):
        low = X.lower_ascii(data)
        start, end, row = X.word_spans(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
        yield first, last, low, start, end, row, keys(low, start, end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a run of texts: how often, and how often in training texts."""
    for batch in batches:
        train = np.array(X.column(batch, "train").to_pylist(), dtype=bool)
        for first, last, low, start, end, row, h in _words(X.column(batch, "text")):
            _, where, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = np.bincount(inverse, train[first:last][row], minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_taken(low, start[where], end[where]), pa.array(n, pa.int64()), pa.array(known)], ["word", "every", "n"])


_PART = pa.schema([("word", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64()), ("times", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])


def _parts(frequent: tuple[np.ndarray, ...], last_token: tuple[bool, float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text a row with the sums over its frequent words and its end, and a row for each other word.

    ``frequent`` has hashes in ascending order, places in the joined words, the words, known, base and lp.
    """
    hashes, bounds, bodies, f_known, f_base, f_lp = frequent

    def same(low: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the span has the bytes of the frequent word of equal hash."""
        size = end - start
        out = size == bounds[slot + 1] - bounds[slot]
        some = np.flatnonzero(out)
        ends = np.cumsum(size[some])
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size[some], size[some])
        unlike = low[np.repeat(start[some], size[some]) + step] != bodies[np.repeat(bounds[slot[some]], size[some]) + step]
        out[some[np.repeat(np.arange(len(some)), size[some])[unlike]]] = False
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = X.column(batch, "doc_id"), X.column(batch, "h").to_numpy()
            for first, last, low, start, end, row, h in _words(X.column(batch, "text")):
                n_rows = last - first
                order = np.lexsort((h, row))
                r, k = row[order], h[order]
                edge = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))[: len(r)]
                where = order[edge]
                times = np.diff(np.append(np.flatnonzero(edge), len(r)))
                r, k, s, e = row[where], h[where], start[where], end[where]
                slot = np.minimum(np.searchsorted(hashes, k), max(len(hashes) - 1, 0))
                hit = (hashes[slot] == k) if len(hashes) else np.zeros(len(k), bool)
                hit[hit] = same(low, s[hit], e[hit], slot[hit])
                own, rt, rr = slot[hit], times[hit], r[hit]
                end_known, end_base, end_lp = last_token

                def summed(values: np.ndarray, more: float) -> np.ndarray:
                    return np.bincount(rr, values, minlength=n_rows) + more

                known = summed(rt * f_known[own], end_known).astype(np.int64) if len(hashes) else np.full(n_rows, int(end_known))
                base = summed(rt * f_base[own], end_base) if len(hashes) else np.full(n_rows, end_base)
                lp = summed(rt * f_lp[own], end_lp) if len(hashes) else np.full(n_rows, end_lp)
                tokens = np.bincount(row, minlength=n_rows) + 1
                # a text's own row goes through the join under a name that no word has
                names = [b" %d" % m for m in marks[first:last]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), ids.slice(first, n_rows), pa.array(marks[first:last]), pa.nulls(n_rows, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known), pa.array(base), pa.array(lp)],
                    schema=_PART,
                )
                rest, n = ~hit, int((~hit).sum())
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [_taken(low, s[rest], e[rest]), ids.take(pa.array(first + r[rest])), pa.array(marks[first + r[rest]]), pa.array(times[rest], pa.int64()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                        schema=_PART,
                    )

    return run


def score(docs: DataFrame, path: str, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of each whole text by a lattice of pieces, and by counted words for comparison.

    Tokens are the words between white space, A-Z in lower case, and one end for each text. A text's probability is that of its words and end;
    a word's is the sum over all its segmentations into pieces of the sentencepiece model at ``path``, its space
    being part of the first. Weights of the pieces start as the vocabulary's scores and are learned from the words of all texts that aren't ``held_out``
    by expected counts. ``base_score`` sums log10((c + 1) / (N + V + 1)) over tokens.

    Returns for each row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. A null text is empty, an empty
    one has its end alone; null ids and repeated rows are scored like others; without training texts the vocabulary's scores stand
    alone; an empty table gives no rows. Scores agree from run to run but for the order of sums.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    counted = rows.select("text", (~F.col("held")).alias("train")).mapInArrow(_count, "word binary, every long, n long")
    words = _kept(counted.groupBy("word").agg(F.sum("every").alias("every"), F.sum("n").alias("n")), "words")
    all_words, train_words, distinct = words.agg(F.coalesce(F.sum("every"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    ends = rows.where("not held").count()
    tokens, kinds = train_words + ends, distinct + (ends > 0)
    weight = _learn(words.where("n > 0"), path, ends)
    nat = np.log(10)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, n, word in _batched(batches, "n"):
            lp = forward_backward(data, offsets, weight, path)[0] / nat
            yield pa.RecordBatch.from_arrays([word, pa.array(n), pa.array(np.log10((n + 1) / (tokens + kinds + 1))), pa.array(lp)], ["word", "n", "base", "lp"])

    # at most FREQUENT words have a part in FREQUENT of all
    often = words.where(F.col("every") * FREQUENT >= all_words).mapInArrow(rate, "word binary, n long, base double, lp double").toArrow()
    seldom = words.where(F.col("every") * FREQUENT < all_words).mapInArrow(rate, "word binary, n long, base double, lp double")
    body = [w for w in often.column("word").to_pylist()]
    flat = np.frombuffer(b"".join(body), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in body]))).astype(np.int64)
    h = keys(flat, bounds[:-1], bounds[1:])
    order = np.argsort(h, kind="stable")
    size = np.diff(bounds)[order]
    flat = np.frombuffer(b"".join(body[i] for i in order), dtype=np.uint8)
    values = [often.column(c).to_numpy()[order] for c in ("n", "base", "lp")]
    frequent = (h[order], np.concatenate(([0], np.cumsum(size))).astype(np.int64), flat, (values[0] > 0).astype(np.int64), values[1], values[2])
    end_id = vocabulary(path)[3]
    last_token = (ends > 0, float(np.log10((ends + 1) / (tokens + kinds + 1))), float(weight[end_id] / nat))
    marked = rows.select("doc_id", F.xxhash64("text", F.lit(1)).alias("h"), "text")
    parts = marked.mapInArrow(_parts(frequent, last_token), "word binary, doc_id long, h long, times long, tokens long, known long, base double, lp double")
    seldom = seldom.select("word", (F.col("n") > 0).cast("long").alias("w_known"), F.col("base").alias("w_base"), F.col("lp").alias("w_lp"))
    joined = parts.join(seldom, "word", "left")
    times = F.col("times")
    sums = joined.groupBy("doc_id", "h").agg(
        F.count("tokens").alias("copies"), F.max("tokens").alias("n_tokens"),
        *(F.sum(F.coalesce(F.col(c), times * F.col(f"w_{c}"))).alias(c) for c in ("known", "base", "lp")),
    )
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    out = sums.select("*", again)
    copies = F.col("copies")
    out = out.select("doc_id", "n_tokens", (F.col("known") / copies).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") / copies).alias("base_score"), (F.col("lp") / copies).alias("score"))
    return out.withColumnRenamed("doc_id", id)
