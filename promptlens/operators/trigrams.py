"""Skipping files that cannot hold a substring: the trigrams of each file as a Bloom filter, beside the table.

A substring's trigrams are trigrams of every text that holds it. ``_trigrams`` in the table's folder has, for each indexed
file and text column, bitmaps of hashed trigrams. Files without an index are read, so the index may lag behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.operators.curate import table_parts
from promptlens.plans.reports import mentions

#: Bits of a file's filter, as parts of 2**15: few of them are set for columns of few different trigrams.
PARTS = 8
INDEX = "file string, column string, part int, bits binary"


def trigrams(text: Column) -> Column:
    """All distinct runs of three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), 1))


def _slot(trigram: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(trigram), F.lit(PARTS << 15))
    return F.shiftright(h, 15).cast("int"), h.bitwiseAND(F.lit(32767).cast("long"))


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(INDEX).parquet(f"{path}/_trigrams")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def index_files(spark: SparkSession, path: str, columns: Sequence[str] = ("operational_entity",)) -> None:
    """Index the files that are not yet indexed for these columns; can be repeated after any failure.

    Rows are reduced to one bitmap a task, file and part before anything is shuffled.
    """
    held = _index(spark, path)
    for column in columns:
        rows = reduce(DataFrame.unionByName, (p.select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("text")) for p in table_parts(spark, path)))
        if held is not None:
            done = held.where(F.col("column") == column).select("file").distinct()
            rows = rows.join(done, "file", "left_anti")
        part, place = _slot(F.col("trigram"))
        each = rows.select("file", F.explode(trigrams(F.coalesce("text", F.lit("")))).alias("trigram")).select("file", part.alias("part"), place.alias("place"))
        bitmaps = each.groupBy("file", "part").agg(F.bitmap_construct_agg("place").alias("bits"))
        # a file without trigrams is indexed too
        marks = rows.select("file").distinct().select("file", F.lit(-1).alias("part"), F.lit(b"").alias("bits"))
        out = bitmaps.unionByName(marks).select("file", F.lit(column).alias("column"), "part", "bits")
        out.write.mode("append").parquet(f"{path}/_trigrams")


def skipped(spark: SparkSession, path: str, column: str, terms: Sequence[str]) -> list[str]:
    """Indexed files that hold none of the terms for sure. One name for each of them reaches the driver."""
    held = _index(spark, path)
    if held is None:
        return []
    part, place = _slot(F.col("trigram"))
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.explode(trigrams(F.col("term"))).alias("trigram"))
    slots = wanted.select("term", part.alias("part"), place.alias("place")).distinct().collect()  # a few for each term
    short = {t for t in terms if t not in {s["term"] for s in slots}}
    if short:  # of fewer than three characters: any file may hold it
        return []
    byte = lambda at: F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("long")

    def found(s) -> Column:
        return F.max((F.col("part") == s["part"]) & (F.getbit(byte(s["place"]), F.lit(s["place"] % 8)) == 1))

    rows = held.where(F.col("column") == column).groupBy("file").agg(*(F.coalesce(found(s), F.lit(False)).alias(f"s{i}") for i, s in enumerate(slots)))
    may = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(f"s{i}") for i, s in enumerate(slots) if s["term"] == t)) for t in terms))
    return [r["file"] for r in rows.where(~may).select("file").collect()]


def holding(spark: SparkSession, path: str, terms: Sequence[str], column: str = "operational_entity") -> DataFrame:
    """Rows whose column holds one of the terms: the exact filter, over the files that may hold it."""
    out = skipped(spark, path, column, terms)
    parts = [p.where(~F.col("_metadata.file_path").isin(out)) if out else p for p in table_parts(spark, path)]
    return reduce(DataFrame.unionByName, parts).where(mentions(F.col(column), terms))
