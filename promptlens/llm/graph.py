"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.session import scratch_path


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: later rounds don't depend on earlier ones."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(links: DataFrame) -> DataFrame:
    """One round: link larger neighbours, then all others, to the smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in ``links`` (a, b); the component is the smallest id reachable.

    Rounds of large and small stars until nothing moves, a few even for long chains. Partial
    aggregates precede each shuffle, so an id with very many links is no single task's work.
    """
    state = _kept(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = None
    while True:
        now = state.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == known or not now[0]:
            break
        known = now
        state = _kept(_stars(state), "links")
    return state.select(F.col("a").alias("id"), F.col("b").alias("component")).union(state.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
