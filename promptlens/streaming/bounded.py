"""Window counters of a stream whose state is bounded, with every late row kept in sight.

Windows close once the horizon, the latest event time less a delay, has passed their end. Ids are remembered
while their windows are open. Rows of closed windows are no loss: they go to a side output, are counted, and name the
windows to be counted again from the table, whose ledger knows every id.

Under ``path`` lie ``closed``, ``late`` (a folder per batch), ``open`` (the windows still open after a batch), ``seen`` (ids as runs) and
``_done``, a file name per finished batch with the horizon that it left. A batch that is repeated replaces what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptlens.operators.curate import dedupe
from promptlens.operators.runs import Run, Runs
from promptlens.session import file_names, remove_file, scratch_path, touch_file

COUNTS = ["total_prompts", "dlp_flagged_prompts", "ssn_prompts", "toxic_combination_prompts"]
KEPT = ["insert_id", "event_timestamp", "trace_id", "span_id", "pillar", "dlp_detected", "contains_ssn", "is_toxic_combination"]
OPEN = "window_start timestamp, window_end timestamp, pillar string, " + ", ".join(f"{c} long" for c in COUNTS)
LATE = ", ".join(f"{c} {'timestamp' if c == 'event_timestamp' else 'boolean' if c in KEPT[5:] else 'string'}" for c in KEPT) + ", window_start timestamp, window_end timestamp, batch long"


def _counted(rows: DataFrame) -> DataFrame:
    flags = [F.count("*"), *(F.count_if(F.coalesce(c, F.lit(False))) for c in KEPT[5:])]
    return rows.groupBy("window_start", "window_end", "pillar").agg(*(a.alias(c) for a, c in zip(flags, COUNTS)))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("window_start", "window_end", "pillar").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _windowed(rows: DataFrame, window: str) -> DataFrame:
    w = F.window("event_timestamp", window)
    return rows.withColumn("_w", w).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


class Seen(Runs):
    """Ids of open windows. A run's name tells the batch that wrote it and its latest window end, so what an
    unfinished batch wrote doesn't count and what is behind the horizon goes as a whole."""

    def __init__(self, spark: SparkSession, path: str, done: int):
        super().__init__(spark, path, "insert_id", "insert_id string, window_end timestamp")
        self.done = done

    def live(self) -> list[Run]:
        return [r for r in super().live() if int(r.name.split("-")[0]) <= self.done]

    def expire(self, horizon: int) -> None:
        for run in self.live():
            if int(run.name.split("-")[1]) <= horizon:
                self.drop(run)


def _micros(column: Column) -> Column:
    return F.unix_micros(column)


def _at(horizon: int) -> Column:
    return F.timestamp_micros(F.lit(horizon))


@dataclass(frozen=True)
class BoundedCounters:
    """Exposure counters per tumbling window and pillar, each id once, with state for ``delay`` and no more."""

    path: str
    window: str = "1 hour"
    delay: str = "2 days"

    def _done(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(batch, horizon in microseconds) of finished batches; the last two are kept."""
        return sorted((int(a), int(b)) for a, b in (name.split(".") for name in file_names(spark, f"{self.path}/_done")))

    def add(self, batch: DataFrame, number: int) -> None:
        """Count one batch of rows; repeated under its number it changes nothing."""
        spark = batch.sparkSession
        done = self._done(spark)
        last, horizon = done[-1] if done else (-1, -(1 << 62))
        if number <= last:
            return
        staged = scratch_path(spark, "window-rows")
        _windowed(dedupe(batch.select(*KEPT)), self.window).write.parquet(staged)
        rows = spark.read.parquet(staged)
        newest = rows.agg(F.max(_micros(F.col("event_timestamp") - F.expr(f"INTERVAL {self.delay}")))).first()[0]
        after = max(horizon, newest if newest is not None else horizon)
        behind = _micros(F.col("window_end")) <= horizon
        rows.where(behind).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        seen = Seen(spark, f"{self.path}/seen", last)
        fresh = rows.where(~behind)
        count = fresh.count()
        new = scratch_path(spark, "new-window-rows")
        seen.without(fresh, count).write.parquet(new)
        fresh = spark.read.parquet(new)
        latest = fresh.agg(F.max(_micros(F.col("window_end")))).first()[0]
        if latest is not None:
            seen.mark(seen.write(fresh, count, f"{number}-{latest}"))
        counts = _counted(fresh)
        if last >= 0:
            counts = _summed(counts.unionByName(spark.read.schema(OPEN).parquet(f"{self.path}/open/{last}")))
        state = scratch_path(spark, "windows")
        counts.write.parquet(state)
        counts = spark.read.parquet(state)
        over = _micros(F.col("window_end")) <= after
        counts.where(over).write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
        counts.where(~over).write.mode("overwrite").parquet(f"{self.path}/open/{number}")
        touch_file(spark, f"{self.path}/_done/{number}.{after}")
        for old, at in done[:-1]:
            remove_file(spark, f"{self.path}/_done/{old}.{at}")
            remove_file(spark, f"{self.path}/open/{old}")
        seen = Seen(spark, f"{self.path}/seen", number)
        seen.expire(after)
        seen.compact(
            lambda rows: rows.where(_micros(F.col("window_end")) > after),
            lambda runs: f"{number}-{max(int(r.name.split('-')[1]) for r in runs)}",
        )

    def start(self, rows: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()

    def closed(self, spark: SparkSession) -> DataFrame:
        """Windows that are over, each once."""
        return spark.read.schema(OPEN).parquet(f"{self.path}/closed").select("window_start", "window_end", "pillar", *COUNTS)

    def open(self, spark: SparkSession) -> DataFrame:
        """Windows that may still grow, as of the last batch."""
        return spark.read.schema(OPEN).parquet(f"{self.path}/open/{self._done(spark)[-1][0]}")

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came when their windows were closed, redeliveries among them."""
        return spark.read.schema(LATE).parquet(f"{self.path}/late")

    def settled(self, table: DataFrame) -> DataFrame:
        """All windows, those that late rows belong to counted again from the curated table.

        Only the dates of such windows are read of the table, which has each id once.
        """
        spark = table.sparkSession
        places = self.late(spark).select("window_start", "window_end", "pillar").distinct()
        dates = places.select(F.explode(F.array(F.to_date("window_start"), F.to_date(F.col("window_end") - F.expr("INTERVAL 1 MICROSECOND")))).alias("event_date")).distinct()
        again = _windowed(table.join(dates, "event_date", "left_semi").select("pillar", "event_timestamp", *KEPT[5:]), self.window)
        again = _counted(again.join(places, ["window_start", "window_end", "pillar"], "left_semi"))
        rest = self.closed(spark).unionByName(self.open(spark)).join(places, ["window_start", "window_end", "pillar"], "left_anti")
        return rest.unionByName(again.select(rest.columns))
