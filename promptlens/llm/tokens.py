"""Tokens of whole texts: counts that are looked up by digest before anything is encoded, and ids."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm import text as X

#: Digests that a map task remembers to send each text once; forgetting only costs bytes.
REMEMBERED = 200_000

_STORED = "tokenizer string, digest binary, n_tokens long"

#: Special token of the byte-level vocabulary, and the characters for which both libraries'
#: character classes were compared one by one.
END_OF_TEXT = "<|endoftext|>"
_BEYOND = re.compile("[^\u0000-ɏ]")


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _byte_level(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ranks(path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def encode(texts: list[str], path: str, ranks: tuple | None = None) -> list[np.ndarray]:
    """Token ids of each text, without added tokens; special strings as the library reads them by default.

    ``.model`` files are read by sentencepiece, ``.json`` files by tokenizers. ``ranks`` (path,
    pattern, special tokens) names the same vocabulary as ranks, several times as fast; it is used for
    texts of characters below U+0250, on which both split text alike.
    """
    if path.endswith(".model"):
        return [np.asarray(ids, dtype=np.uint32) for ids in _pieces(path).encode(texts, num_threads=1)]
    if ranks is None:
        return [np.asarray(e.ids, dtype=np.uint32) for e in _byte_level(path).encode_batch(texts, add_special_tokens=False)]
    out: list = [None] * len(texts)
    rare = []
    fast = _ranks(*ranks)
    for i, one in enumerate(texts):
        if one.isascii() or not _BEYOND.search(one):
            out[i] = fast.encode_to_numpy(one, allowed_special="all")
        else:
            rare.append(i)
    if rare:
        for i, ids in zip(rare, encode([texts[i] for i in rare], path)):
            out[i] = ids
    return out


def encode_batch(texts: pa.Array, path: str, ranks: tuple | None = None):
    """(first row, ids of each row) for bounded runs of rows; a null text is empty."""
    filled = pc.fill_null(texts, "")
    for first, last, _, _ in X.pieces(texts):
        yield first, encode(filled.slice(first, last - first).to_pylist(), path, ranks)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the version of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.__version__.encode()).hexdigest()


def _once(batches):
    """Each digest once, as far as memory is set aside for it."""
    seen: set[bytes] = set()
    for batch in batches:
        digests = X.column(batch, "digest").to_pylist()
        keep = []
        for i, digest in enumerate(digests):
            if digest not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                keep.append(i)
        if len(keep) == len(digests):
            yield batch
        elif keep:
            yield batch.take(pa.array(keep))


def _count(path: str):
    def count(batches):
        seen: set[bytes] = set()  # a digest's rows are all in this partition
        for batch in batches:
            digests = X.column(batch, "digest").to_pylist()
            keep = [i for i, digest in enumerate(digests) if digest not in seen and not seen.add(digest)]
            batch = batch.take(pa.array(keep, pa.int64()))
            sizes = [len(ids) for _, rows in encode_batch(X.column(batch, "text"), path) for ids in rows]
            yield pa.RecordBatch.from_arrays([X.column(batch, "digest"), pa.array(sizes, pa.int64())], ["digest", "n_tokens"])

    return count


def stored_counts(spark, cache: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version in the cache, None where nothing was stored yet."""
    try:
        stored = spark.read.schema(_STORED).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each whole text, encoding only texts that the cache doesn't know.

    The cache is a Parquet folder of (tokenizer version, SHA-256 of the text's UTF-8 bytes, count).
    Digests of the table are looked up there, each distinct miss is encoded once, and the new counts
    are appended before the result is read. A tokenizer file or library of another version has entries
    of its own. The text itself is digested as it is, since any further normalising could change
    its count; a null text counts as the empty one.

    Returns id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``), a row for each row:
    repeated rows and null ids are kept as they are. An empty table gives an empty result and adds
    nothing. Other columns never matter.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    known = stored_counts(spark, cache, version)
    misses = docs.select(digest, content.alias("text")).mapInArrow(_once, "digest binary, text string")
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    fresh = misses.repartition("digest").mapInArrow(_count(path), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = stored_counts(spark, cache, version)
    rows = docs.select(F.col(id).alias(id), digest, F.octet_length(content).cast("long").alias("n_bytes"))
    return rows.join(counts, "digest", "left").select(id, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
