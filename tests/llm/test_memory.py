"""What a task holds while it works on a batch of texts: a piece's arrays, however large the batch."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from promptlens.llm import chain, grade, minhash, suffix


@pytest.mark.parametrize("name", ["suffix", "chain", "grade", "minhash"])
def test_a_batch_is_worked_on_in_small_pieces(name):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    steps = {
        "suffix": lambda: suffix._entries(suffix.LENGTH, suffix.SEED, 8, 8)(iter([batch])),
        "chain": lambda: chain._scan(8, 8)(iter([batch])),
        "grade": lambda: grade._score(SimpleNamespace(value=grade.Model(np.zeros(1 << grade.BITS), np.array([0.0, 1.0]))))(iter([batch])),
        "minhash": lambda: minhash.shingle_sets(batch.column(1), 5),
    }
    run = steps[name]()
    tracemalloc.start()
    try:
        for _ in run:
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 5 << 20 and peak < 64 << 20
