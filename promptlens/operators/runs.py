"""Keyed sets that grow by small appends and are asked which of a batch's keys they hold.

A set is a folder of runs. Each run is sorted by key in hash buckets of bounded size, with Bloom filters on the key; a
file name in ``_marks`` makes it part of the set. Runs of like size are merged, so a set of N keys has few of them.
One writer at a time. Every step can be repeated: a run without mark doesn't count, and one that is there twice
(a merge that broke off) says the same twice.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.session import file_names, remove_file, touch_file

#: Rows of a bucket, about: one file of one row group.
BUCKET_ROWS = 1_000_000
#: Runs of one size class that are merged to one of the next.
FANOUT = 8
#: Batches of so many keys are looked up by bucket and Bloom filter, larger ones joined; both give the same rows.
LOOKUP = 1000
#: Keys that may be sent to every task, through the driver. Sorted ids take a few bytes each in files and over a hundred in memory, so
#: the size of the files, by which Spark would choose, says little.
SENT = 50_000


def joined_by(keys: DataFrame, about: int) -> DataFrame:
    """A join's side of ``about`` rows at most: merged by key, where it is too large to be sent."""
    return keys if about <= SENT else keys.hint("merge")


@dataclass(frozen=True)
class Run:
    name: str
    tier: int
    rows: int
    buckets: int

    @property
    def mark(self) -> str:
        return f"{self.name}.{self.tier}.{self.rows}.{self.buckets}"


def buckets_for(rows: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))


class Runs:
    """The runs under a path; ``schema`` (DDL) has the key and what is kept with it."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.columns = [part.split()[0] for part in schema.split(",")]

    def live(self) -> list[Run]:
        parts = (name.split(".") for name in file_names(self.spark, f"{self.path}/_marks"))
        return sorted((Run(name, int(tier), int(rows), int(buckets)) for name, tier, rows, buckets in parts), key=lambda r: r.rows)

    def write(self, rows: DataFrame, about: int, name: str | None = None, tier: int = 0) -> Run:
        """Write a run of ``about`` rows at most; it counts once :meth:`mark` is called."""
        run = Run(name or uuid.uuid4().hex, tier, about, buckets_for(about))
        rows, folder = rows.select(*self.columns), f"{self.path}/{run.name}"
        if run.buckets == 1:  # bounded by BUCKET_ROWS
            writer = rows.repartition(1).sortWithinPartitions(self.key).write
        else:
            writer = rows.repartition(run.buckets, self.key).write.bucketBy(run.buckets, self.key).sortBy(self.key)
        writer = writer.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(max(1, -(-about // run.buckets))))
        if run.buckets == 1:
            writer.parquet(folder)
        else:
            writer.option("path", folder).format("parquet").saveAsTable(self._table(run))
        return run

    def mark(self, run: Run) -> None:
        touch_file(self.spark, f"{self.path}/_marks/{run.mark}")

    def drop(self, run: Run) -> None:
        """Take a run out of the set, then remove its files."""
        remove_file(self.spark, f"{self.path}/_marks/{run.mark}")
        if run.buckets > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        remove_file(self.spark, f"{self.path}/{run.name}")

    def _table(self, run: Run) -> str:
        return f"run_{run.name.replace('-', '_')}"

    def read(self, run: Run) -> DataFrame:
        if run.buckets == 1:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{run.name}")
        # another session's catalog may not know the run's buckets
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table(run)} ({self.schema}) USING parquet"
            f" CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {run.buckets} BUCKETS LOCATION '{self.path}/{run.name}'"
        )
        return self.spark.read.table(self._table(run))

    def files(self, run: Run) -> DataFrame:
        """A run's rows without its buckets: joined with wide rows, a few buckets would be few tasks."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{run.name}")

    def parts(self) -> list[tuple[DataFrame, int]]:
        """The set as few frames, and their rows at most: the small runs together, each large one with its buckets."""
        runs = self.live()
        small = [r for r in runs if r.buckets == 1]
        together = [(reduce(DataFrame.unionByName, (self.read(r) for r in small)), sum(r.rows for r in small))] if small else []
        return together + [(self.read(r), r.rows) for r in runs if r.buckets > 1]

    def rows(self) -> DataFrame | None:
        parts = [part for part, _ in self.parts()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _few(self, rows: DataFrame, about: int) -> list | None:
        """The batch's keys, where they are few."""
        if about > LOOKUP:
            return None
        return [r[0] for r in rows.select(self.key).where(F.col(self.key).isNotNull()).distinct().collect()]

    def without(self, rows: DataFrame, about: int) -> DataFrame:
        """Rows (``about`` of them) whose key isn't in the set.

        The large runs' side of a join is read bucket by bucket, without a shuffle.
        """
        few = self._few(rows, about)
        for part, size in self.parts():
            held = part.select(self.key)
            held = joined_by(held, size) if few is None else held.where(F.col(self.key).isin(few))
            rows = rows.join(held, self.key, "left_anti")
        return rows

    def having(self, rows: DataFrame, about: int) -> DataFrame | None:
        """What the set keeps for the keys of ``rows``; None for an empty set."""
        few = self._few(rows, about)
        keys = joined_by(rows.select(self.key), about)
        found = [p.join(keys, self.key, "left_semi") if few is None else p.where(F.col(self.key).isin(few)) for p, _ in self.parts()]
        return reduce(DataFrame.unionByName, found) if found else None

    def compact(self, keep: Callable[[DataFrame], DataFrame] | None = None, name: Callable[[list[Run]], str] | None = None) -> None:
        """Merge the runs of each size class that has FANOUT of them, the smallest first.

        ``keep`` leaves out rows that need not be kept, ``name`` names the merged run.
        """
        tier = 0
        while True:
            runs = self.live()
            if tier > max((r.tier for r in runs), default=-1):
                return
            due = [r for r in runs if r.tier == tier]
            if len(due) >= FANOUT:
                together = reduce(DataFrame.unionByName, (self.read(r) for r in due))
                together = keep(together) if keep else together
                tag = f"{name(due)}-{uuid.uuid4().hex[:8]}" if name else None
                self.mark(self.write(together, sum(r.rows for r in due), tag, tier + 1))
                for r in due:
                    self.drop(r)
            tier += 1
