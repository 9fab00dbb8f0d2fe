"""Turns of conversations as sequences: digests and positions, however long one conversation is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptlens.llm.graph import _kept


def short_hash(*parts: Column) -> Column:
    """The first 128 bits of the SHA-256 of the joined parts."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def digest(role: Column, text: Column) -> Column:
    """Equal for equal pairs of role and text only; neither may be null."""
    return short_hash(F.octet_length(role).cast("string"), F.lit(":"), role, text)


def numbered(rows: DataFrame, key: str, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows with their place (from 1) in the order of their key, and ``total``, the rows of the key.

    Rows are range-partitioned by key and order, so a key with very many rows lies in many partitions;
    each partition's rows of a key count on from those before. Keys must not be null.
    """
    columns = rows.columns
    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    # written, since the numbers must not change when a task is repeated
    ranged = _kept(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    starts = ranged.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = W.partitionBy(key)  # a row for each partition that holds the key
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(key, "_part", (before - F.col("_first") + 1).alias("_add"), F.sum("_n").over(own).alias("total"))
    out = ranged.join(starts, [key, "_part"])
    return out.select(*columns, (F.col("_at") + F.col("_add")).alias(name), "total")
