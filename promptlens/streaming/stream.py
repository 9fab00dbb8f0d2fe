"""Structured Streaming: continuous curation and governance counters.

Nothing here drops a late row by default. A watermark bounds state at the price of late rows;
it is set only where a caller passes ``delay``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions.hashing import ActorKey
from promptlens.operators.counters import DELIVERED, STORED, Loaded, keep, observe
from promptlens.operators.curate import add_metrics, dedupe, dedupe_by_date, deliveries, drop_identity, named, rejects
from promptlens.operators.judge import answers_at, judge_stored, rule_judge
from promptlens.operators.ledger import append_once, append_staged, ledger, recover
from promptlens.session import scratch_path


def dedup_stream(rows: DataFrame, delay: str | None = None) -> DataFrame:
    """One row per ``insert_id``.

    State holds every id (use the RocksDB state store); with ``delay`` only those of the watermark, and rows
    behind it are lost. The table's ledger does the same without state: see :func:`stream_curate`.
    """
    if delay is None:
        return rows.dropDuplicates(["insert_id"])
    return rows.withWatermark("event_timestamp", delay).dropDuplicatesWithinWatermark(["insert_id"])


@dataclass(frozen=True)
class Judge:
    """An external judge for streams and back-fills; its answers are kept beside the table and used again."""

    client_factory: Callable[[], Callable[[list[str]], list[str]]]
    attempts: int = 2
    batch_rows: int = V.CHUNK_ROWS
    parallelism: int | None = None


def load(messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, path: str, reject_path: str, judge: Judge | None = None, **options) -> Loaded:
    """One batch of messages into the table: new rows are stored, every delivery that can't be is named. Returns the totals,
    which are counted while the rows are written.

    Messages are parsed and masked once, into the shared folder. Rejects replace what ``reject_path`` holds, so a
    repeated batch names each once; with a judge they include the rows whose answers stayed invalid. Redeliveries
    are neither judged nor stored again.
    """
    spark = messages.sparkSession
    staged = scratch_path(spark, "delivered")
    came, stored = Observation(), Observation()
    observe(deliveries(messages, detectors, key, **options), DELIVERED, came).write.parquet(staged)
    delivered = spark.read.parquet(staged)
    counts = dict(came.get)
    bad, good = named(delivered), delivered.where("reason is null")
    if judge is None:
        count = append_staged(good, path, lambda new: observe(drop_identity(add_metrics(rule_judge(dedupe_by_date(new)))), STORED, stored), dealt=True)
    else:
        recover(spark, path)
        new = dedupe(ledger(spark, path).without(good, good.count()))
        store = answers_at(spark, f"{path}/_answers")
        judged, lost = judge_stored(new, judge.client_factory, store, judge.attempts, batch_rows=judge.batch_rows, parallelism=judge.parallelism)
        staged = scratch_path(spark, "judged")
        drop_identity(add_metrics(judged)).write.parquet(staged)
        count = append_staged(spark.read.parquet(staged), path, lambda new: observe(new, STORED, stored))
        bad = bad.unionByName(lost)
    refused = Observation()
    observe(bad, {"judged_invalid": "reason like 'invalid judgement%'"}, refused).write.mode("overwrite").parquet(reject_path)
    return Loaded(**counts, **refused.get, **(stored.get if count else {}))


def stream_curate(
    messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, path: str, checkpoint: str, reject_path: str | None = None,
    available_now: bool = True, interval: str = "1 minute", curate_batch: Callable[[DataFrame], DataFrame] | None = None, judge: Judge | None = None, **options,
) -> StreamingQuery:
    """The batch curation of each micro-batch, appended to the same table as batch loads and back-fills.

    At-least-once batches become exactly-once rows by the ledger of ids, which keeps no state in the stream, so
    a redelivery is caught however late it comes and a late row is never dropped. Rejects go to ``reject_path``, by default
    ``_rejects`` beside the table (:func:`read_rejects`), a folder per checkpoint and batch that a repeated batch replaces. A failing
    sink or judge fails the query; it restarts from the checkpoint, and answers that a judge gave are not asked for again.
    Totals of each batch are counted by its writes and kept beside the table (:func:`promptlens.operators.counters.kept`).
    ``options`` go to :func:`promptlens.operators.curate.deliveries`.
    """
    folder = reject_path or rejects_of(path)
    origin: list[str] = []

    def append(batch: DataFrame, batch_id: int) -> None:
        if not origin:  # the checkpoint's own id: another one numbers its batches from 0 again
            line = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()
            origin.append(json.loads(line[0])["id"])
        target = f"{folder}/origin={origin[0]}/batch={batch_id}"
        if curate_batch is None:
            keep(batch.sparkSession, path, origin[0], str(batch_id), load(batch, detectors, key, path, target, judge, **options))
        else:
            append_once(curate_batch(batch), path, distinct=True)
            rejects(batch).write.mode("overwrite").parquet(target)

    writer = messages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def rejects_of(path: str) -> str:
    """Where the rejects of a table are kept, unless a caller names another folder; readers of the table skip it."""
    return f"{path}/_rejects"


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, insert_id, reason, origin, batch) of all loads of a table."""
    return spark.read.schema("event_id string, insert_id string, reason string, origin string, batch string").parquet(rejects_of(path))


def backfill(messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, path: str, judge: Judge | None = None, name: str | None = None, **options) -> int:
    """Messages that the stream didn't get: the same transforms, table, ledger and rejects as a batch. Returns the rows added.

    ``name`` is the back-fill's own; one that is repeated under its name replaces its rejects.
    """
    name = name or uuid.uuid4().hex
    loaded = load(messages, detectors, key, path, f"{rejects_of(path)}/origin=backfill/batch={name}", judge, **options)
    keep(messages.sparkSession, path, "backfill", name, loaded)
    return loaded.stored


def governance_counters(rows: DataFrame, window: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Exposure counters per tumbling window and pillar; a redelivered id counts once.

    Windows stay open, so late rows still count: write it in output mode ``complete`` or ``update``. With ``delay`` a window
    is emitted once, when the watermark has passed it, and later rows are lost.
    """
    return (
        dedup_stream(rows, delay)
        .groupBy(F.window("event_timestamp", window).alias("w"), "pillar")
        .agg(
            F.count("*").alias("total_prompts"),
            F.count_if("dlp_detected").alias("dlp_flagged_prompts"),
            F.count_if("contains_ssn").alias("ssn_prompts"),
            F.count_if("is_toxic_combination").alias("toxic_combination_prompts"),
        )
        .select(
            F.col("w.start").alias("window_start"), "pillar", "total_prompts",
            "dlp_flagged_prompts", "ssn_prompts", "toxic_combination_prompts",
        )
    )


def unique_actors_stream(rows: DataFrame, window: str = "1 day", delay: str | None = None) -> DataFrame:
    """Distinct actors per window; exact distinct counts are not available on streams. ``delay`` as in
    :func:`governance_counters`."""
    rows = rows if delay is None else rows.withWatermark("event_timestamp", delay)
    return (
        rows.groupBy(F.window("event_timestamp", window).alias("w"))
        .agg(F.approx_count_distinct("anonymous_actor_hash").alias("actors"))
        .select(F.col("w.start").alias("window_start"), "actors")
    )
