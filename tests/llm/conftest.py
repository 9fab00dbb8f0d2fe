import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as they may come: nulls everywhere, empty and long texts, copies, repeated rows, other columns whose
    names the operators use themselves."""
    prose = " ".join(f"word{i % 97} other{i % 89}" for i in range(400))
    rows = [
        (1, prose, "en", "a", 1, "x"),
        (2, prose, "en", "a", 1, "x"),
        (3, prose[:2000] + " something else entirely at the end of this text", None, None, None, None),
        (4, "", "en", "a", 0, "x"),
        (5, None, "en", "a", None, None),
        (6, "word", "en", "a", 4, "x"),
        (7, "word", "en", "a", 4, "x"),
        (7, "word", "en", "a", 4, "x"),
        (None, "a text without id, but with words enough to be cut into shingles of five", "en", "a", 1, "x"),
        (8, "é" * 300 + "ü", "fr", "b", 301, "x"),
        (9, "é" * 300 + "ü", "fr", "b", 301, "x"),
        (10, "a" * 5000, "en", "b", 5000, "x"),
        (11, "long " * 60_000 + "tail", "en", "b", 300_004, "x"),
        (12, "\t \n ", "en", "b", 4, "x"),
        (13, "<|endoftext|> and 日本語 text \u0000 with odd characters ퟿", "en", "b", 4, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").select(
        "*", *(lit(x) for x in ("k", "data", "row", "n", "size", "shard", "cluster", "spans"))
    )


def lit(name):
    from pyspark.sql import functions as F

    return F.lit("clash").alias(name)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
