"""Graded quality of texts by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm import text as X

BITS = 18
#: Labelled rows that are fitted at most, those of the least hashed ids. Scoring covers all rows.
SAMPLE = 12_000
#: Features that stand in fewer labelled texts are left at zero.
LEAST_TEXTS = 3
ROUNDS = 250
PENALTY = 0.9

_WORD, _MARK, _SHARE = (np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in (1, 2, 3))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and value, sorted by row.

    Each distinct word and each distinct run of marks counts once; so do shares, as a part of all
    words: of each run of marks, of words in capitals, and of words that repeat one of the two before.
    """
    rows = len(offsets) - 1
    low = X.lower_ascii(data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    is_word = ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    sums = X.prefix_sums(low)
    start, end, row = X.word_spans(is_word, offsets)
    h = X.span_hashes(sums, start, end)
    m_start, m_end, m_row = X.word_spans(~is_word & ~white, offsets)
    marks = X.span_hashes(sums, m_start, m_end)
    capital = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    shouted = (capital[end] - capital[start] == end - start) & (end - start > 1)
    again = np.zeros(len(h), dtype=bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (row[back:] == row[:-back])
    words = np.maximum(np.bincount(row, minlength=rows), 1)
    shift = np.uint64(64 - BITS)

    def slot(x: np.ndarray, kind: np.uint64) -> np.ndarray:
        return (X.mix(x ^ kind) >> shift).astype(np.int64)

    once = np.unique(np.concatenate((row << BITS | slot(h, _WORD), m_row << BITS | slot(marks, _MARK))))
    parts = np.concatenate((m_row << BITS | slot(marks, _SHARE), row[shouted] << BITS | 1, row[again] << BITS | 2))
    shares, counts = np.unique(parts, return_counts=True)
    key = np.concatenate((once, shares))
    value = np.concatenate((np.ones(len(once)), 4.0 * np.minimum(counts / words[shares >> BITS], 1.0)))
    order = np.argsort(key, kind="stable")
    return key[order] >> BITS, key[order] & ((1 << BITS) - 1), value[order]


@dataclass
class Model:
    """Weights that all thresholds share, and the thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Proportional-odds model by accelerated proximal steps; each weight's penalty follows how often its
    feature occurs, so that chance doesn't move it."""
    n, size = len(grade), 1 << BITS
    counts = np.bincount(grade, minlength=grades) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.log(below / (1 - below))
    if n == 0:
        return Model(np.zeros(size), theta)
    texts = np.bincount(slot, minlength=size)
    used = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    keep = place[slot] >= 0
    row, col, value = row[keep], place[slot[keep]], value[keep]
    del slot, keep
    mass = np.bincount(row, weights=value, minlength=n)
    step = 1 / np.maximum(0.25 * np.bincount(col, weights=value * mass[row], minlength=len(used)) / n, 1e-12)
    penalty = PENALTY * np.sqrt(np.bincount(col, weights=value * value, minlength=len(used))) / n * 0.35
    low, high = np.append(-np.inf, theta), np.append(theta, np.inf)
    w = z = np.zeros(len(used))
    t, t_step = 1.0, 1.0
    tz = theta.copy()
    for _ in range(ROUNDS):
        score = np.bincount(row, weights=value * z[col], minlength=n)
        low, high = np.append(-np.inf, tz), np.append(tz, np.inf)
        up, down = _logistic(high[grade] - score), _logistic(low[grade] - score)
        up[grade == grades - 1], down[grade == 0] = 1.0, 0.0
        mass_in = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / mass_in, down * (1 - down) / mass_in
        slope = (d_up - d_down) / n  # of the loss in the score
        grad = np.bincount(col, weights=value * slope[row], minlength=len(used))
        g_theta = np.array([d_down[grade == k + 1].sum() - d_up[grade == k].sum() for k in range(grades - 1)]) / n
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_theta = np.sort(tz - t_step * g_theta)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_next * (new - w)
        tz = np.sort(new_theta + (t - 1) / t_next * (new_theta - theta))
        w, theta, t = new, new_theta, t_next
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, theta)


def _hash(batches):
    for batch in batches:
        for first, last, data, offsets in X.pieces(X.column(batch, "text")):
            row, slot, value = features(data, offsets)
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            part = batch.slice(first, last - first)
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [X.column(part, "grade"), pa.array([slot[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary())],
                ["grade", "slots", "values"],
            )


def train(docs: DataFrame, grades: DataFrame, top: int, id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` graded texts (grades 0 to ``top``); rows without id, or without a grade, are left out."""
    rated = grades.select(F.col(id).alias("id"), F.col(grade).cast("int").alias("grade")).where(f"id is not null and grade between 0 and {top}")
    picked = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").mapInArrow(_hash, "grade int, slots binary, values binary")
    got = sorted(rows.collect(), key=lambda r: (r.grade, r.slots, r["values"]))  # whatever order tasks end in
    grade_of = np.array([r.grade for r in got], dtype=np.int64)
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(r.slots) // 4 for r in got])
    slot, value = (np.frombuffer(b"".join(r[c] for r in got), kind) for c, kind in (("slots", "<i4"), ("values", "<f4")))
    del got
    return fit(row, slot, value, grade_of, top + 1)


def _score(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            for first, last, data, offsets in X.pieces(X.column(batch, "text")):
                row, slot, value = features(data, offsets)
                tails = model.tails(np.bincount(row, weights=value * model.weights[slot], minlength=last - first))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, last - first).columns, pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, -1]))],
                    [*batch.schema.names, "expected_grade", "p_top"],
                )

    return score


def graded(docs: DataFrame, model: Model, least: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: id, ``expected_grade``, ``p_top`` (the probability of the highest grade) and ``kept``
    (that it is ``least`` at least).

    A null or empty text has no features, so the thresholds alone speak. Null ids and repeated rows
    are scored row by row; other columns never matter.
    """
    base = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = base.mapInArrow(_score(shared), f"id {kind}, text string, expected_grade double, p_top double")
    return out.select(F.col("id").alias(id), "expected_grade", "p_top", (F.col("p_top") >= least).alias("kept"))


def select_good(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text ``graded`` would keep."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), schema).where(F.col("p_top") >= least).select("row.*")


def label_grades(labels: DataFrame) -> DataFrame:
    """0 for toxic, 1 for low quality, 2 for good text; a null flag counts as unknown, so such rows have no grade."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return labels.select("doc_id", F.when(toxic, 0).when(~good, 1).when(good & ~toxic, 2).alias("grade"))
