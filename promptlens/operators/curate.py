"""From messages to the curated table, and its sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions import metrics as M
from promptlens.functions.hashing import ActorKey
from promptlens.operators.deidentify import deidentify, finding_flags, pseudonymise
from promptlens.operators.judge import judge_with, rule_judge, store_judgements, validate_judge
from promptlens.operators.normalize import flatten
from promptlens.schema import CLUSTER_KEYS, NOT_NULL, curated_schema
from promptlens.session import file_names, settings
from promptlens.sources.logs import decode_messages, drop_empty_messages, is_corrupt, message_text, parse_entry, quarantine_malformed

NUMBERS = ["latency_ms", "prompt_tokens", "response_tokens"]
REQUIRED = ["insert_id", "event_timestamp", *NUMBERS]


def masked_rows(entries: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, style: str = "plain", **options) -> DataFrame:
    """Entries to masked, pseudonymous rows in one narrow stage: nothing raw is left
    when the first shuffle runs. ``options`` (``digits``, ``terms``, ``min_likelihood``) go to
    :func:`promptlens.operators.deidentify.deidentify`, here and in all functions below."""
    return pseudonymise(finding_flags(deidentify(flatten(entries), detectors, key, style, **options)))


def has_key(df: DataFrame) -> DataFrame:
    """Rows that can be deduplicated: id and time are present."""
    return df.where(F.col("insert_id").isNotNull() & F.col("event_timestamp").isNotNull())


def rejected(column_names: Sequence[str]) -> F.Column:
    """Reason a row cannot be stored, or null: first missing column."""
    return F.coalesce(
        *(F.when(F.col(c).isNull(), F.lit(f"missing or invalid {c}")) for c in column_names)
    )


def require_not_null(df: DataFrame, columns: Sequence[str] = tuple(NOT_NULL + NUMBERS)) -> tuple[DataFrame, DataFrame]:
    """Split rows into complete ones and rejects; rejects keep id and reason only."""
    present = [c for c in columns if c in df.columns]
    reason = rejected(present)
    return df.where(reason.isNull()), df.where(reason.isNotNull()).select(
        "insert_id", reason.alias("reason")
    )


def dedupe(df: DataFrame) -> DataFrame:
    """One row per ``insert_id``, the earliest delivery.

    Spark drops local duplicates before the shuffle (window group limit), so many
    copies of one id cost one row per task.
    """
    w = Window.partitionBy("insert_id").orderBy("event_timestamp", "trace_id", "span_id")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def add_metrics(df: DataFrame) -> DataFrame:
    """Multiplier, minutes and the retrieval gap from the judge columns."""
    df = df.withColumn(
        "maturity_multiplier", M.maturity_multiplier(F.col("specification_maturity.level"))
    )
    minutes, multiplier = F.col("estimated_manual_minutes"), F.col("maturity_multiplier")
    return df.withColumns(
        {
            "adjusted_minutes_saved": M.adjusted_minutes(minutes, multiplier),
            "potential_extra_minutes_unlocked": M.extra_minutes(minutes, multiplier),
            "is_retrieval_gap": M.is_retrieval_gap(
                F.col("grounding_analysis.requires_enterprise_knowledge"),
                F.col("grounding_analysis.grounding_type"),
            ),
        }
    )


def drop_identity(df: DataFrame) -> DataFrame:
    """Exactly the 40 declared columns in order, with their descriptions; anything else stays behind."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in curated_schema()))


def curate_entries(entries: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, judge: Callable[[DataFrame], DataFrame] = rule_judge, style: str = "plain", distinct: Callable[[DataFrame], DataFrame] | None = dedupe, **options) -> DataFrame:
    """parse -> mask -> validate -> deduplicate -> judge -> derive -> 40 columns.

    Rows that cannot be stored go first, so a good redelivery of a bad first delivery counts;
    :func:`rejects` names them. Duplicates go before the judge, so a redelivery is never judged twice.
    ``distinct=None`` leaves duplicates in (their removal is then up to the sink).
    """
    rows = masked_rows(entries, detectors, key, style, **options).where(rejected(REQUIRED).isNull())
    if distinct is not None:
        rows = distinct(rows)
    return drop_identity(add_metrics(judge(rows)))


def curate(messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, strict: bool = False, **options) -> DataFrame:
    """Message envelopes (event_id, data) to curated rows; with ``strict`` a present null in the sender's fields stays null."""
    return curate_entries(decode_messages(messages, strict), detectors, key, **options)


def rejects(messages: DataFrame) -> DataFrame:
    """Deliveries that :func:`curate` leaves out, but for empty ones and redeliveries: (event_id, insert_id, reason).

    Messages that do not decode, and entries without a time or with numbers that are none. No text is kept.
    """
    entries, malformed = quarantine_malformed(messages)
    flat = flatten(entries, ["event_id"])
    bad = flat.select("event_id", "insert_id", rejected(["insert_id", "event_timestamp", *NUMBERS]).alias("reason")).where("reason is not null")
    return malformed.select("event_id", F.lit(None).cast("string").alias("insert_id"), "reason").unionByName(bad)


def curate_and_reject(messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, **options) -> tuple[DataFrame, DataFrame]:
    """Rows for the table, and the deliveries that have to be looked at: write both."""
    return curate(messages, detectors, key, **options), rejects(messages)


def curate_judged(
    messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, client_factory: Callable, stored: str, style: str = "plain", batch_rows: int = V.CHUNK_ROWS, parallelism: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Curation with an external judge: (rows, rejects), the latter with every answer that isn't valid.

    Answers are written to ``stored`` first, so each row is judged once however often rows and rejects are read.
    """
    rows = dedupe(masked_rows(decode_messages(messages), detectors, key, style, **options).where(rejected(REQUIRED).isNull()))
    good, bad = validate_judge(store_judgements(judge_with(rows, client_factory, batch_rows, parallelism), stored))
    lost = bad.select(F.lit(None).cast("string").alias("event_id"), "insert_id", "reason")
    return drop_identity(add_metrics(good)), rejects(messages).unionByName(lost)


def deliveries(messages: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, style: str = "plain", strict: bool = False, **options) -> DataFrame:
    """Every message but empty ones, parsed once: masked columns, ``event_id``, and ``reason`` where it can't be stored.

    What a sink with two outputs starts from: rows without reason go on, the others are :func:`named`. Duplicates
    are still in it, raw text isn't.
    """
    entries = F.explode(F.array(parse_entry(message_text(F.col("data")), strict))).alias("entry")
    entries = drop_empty_messages(messages).select("event_id", entries).withColumn("malformed", is_corrupt(F.col("entry")))
    flat = flatten(entries, ["event_id", "malformed"])
    rows = pseudonymise(finding_flags(deidentify(flat, detectors, key, style, **options)))
    reason = F.when(F.col("malformed"), "malformed").otherwise(rejected(["insert_id", *REQUIRED[1:]]))
    return rows.withColumn("reason", reason).drop("malformed")


def named(delivered: DataFrame) -> DataFrame:
    """The deliveries that can't be stored: (event_id, insert_id, reason)."""
    bad = delivered.where("reason is not null")
    return bad.select("event_id", F.when(F.col("reason") != "malformed", F.col("insert_id")).alias("insert_id"), "reason")


def deal_by_date(df: DataFrame) -> DataFrame:
    """Rows dealt to tasks by event date.

    The rebalance shuffle is sized at run time: small dates share a task and a date that
    holds a large share of the rows is split over many. As it goes by date alone, a date
    gets as few files as its size asks for.
    """
    return df.withColumn("event_date", F.to_date("event_timestamp")).hint("rebalance", "event_date")


def dedupe_by_date(df: DataFrame) -> DataFrame:
    """:func:`dedupe`, and the rows it keeps dealt by date.

    For ``distinct`` of :func:`curate`, where the rows go to :func:`write_curated`: what the judge derives from the masked text is
    then derived after the last shuffle.
    """
    return deal_by_date(dedupe(df))


def cluster_for_write(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Lay rows out by date, and by the cluster keys within a file; those ``dealt`` by date already stay where they are.

    Rows are sorted within a file, so row-group statistics skip blocks on the cluster keys.
    """
    dated = df.withColumn("event_date", F.to_date("event_timestamp")) if dealt else deal_by_date(df)
    return dated.sortWithinPartitions("event_date", *CLUSTER_KEYS)


def write_curated(df: DataFrame, path: str, mode: str = "overwrite", dealt: bool = False) -> None:
    """Create or replace (or append to) the table, partitioned by event date."""
    writer = cluster_for_write(df, dealt).write.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy("event_date").parquet(path)


COMPACTED = "_compacted"


def compacted_dates(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """Date to (run, cutoff): the run of a compaction that stands for the date's files up to a modification time in milliseconds."""
    out: dict[str, tuple[str, int]] = {}
    for name in file_names(spark, f"{path}/{COMPACTED}/_done"):
        date, run, cutoff = name.split(".")
        if int(cutoff) > out.get(date, ("", -1))[1]:
            out[date] = run, int(cutoff)
    return out


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands now: of dates that were compacted the compacted files and what was added since.

    A reader keeps the files it was planned with; they stay until :func:`promptlens.operators.compact.vacuum`.
    """
    return reduce(DataFrame.unionByName, table_parts(spark, path))


def table_parts(spark: SparkSession, path: str) -> list[DataFrame]:
    """The files as they were added, and those that a compaction merged."""
    dates = compacted_dates(spark, path)
    if not dates:
        return [spark.read.parquet(path)]
    schema = T.StructType([*curated_schema().fields, T.StructField("event_date", T.DateType())])

    def of(values: dict, kind: str) -> F.Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("event_date").cast("string")].cast(kind)

    cutoff = of({d: c for d, (_, c) in dates.items()}, "long")
    written = F.unix_millis("_metadata.file_modification_time")
    added = spark.read.schema(schema).parquet(path).where(cutoff.isNull() | (written > cutoff))
    merged = spark.read.schema(schema.add("run", "string")).parquet(f"{path}/{COMPACTED}")
    merged = merged.where(F.col("run") == of({d: r for d, (r, _) in dates.items()}, "string")).drop("run")
    return [added, merged]


#: Rows of a file of JSON lines at most: a compressed file is read by one task.
EXPORT_ROWS = 250_000
#: A task keeps so many folders' files open and sorts its rows only where there are more.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "16"}


def _json_lines(df: DataFrame) -> DataFrameWriter:
    """JSON repeats every column's name in every row, so it is over ten times as large as the table where it isn't compressed."""
    return df.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", EXPORT_ROWS)


def export_jsonl(df: DataFrame, path: str) -> None:
    """The table as gzip-compressed JSON lines."""
    _json_lines(df).json(path)


def split_by_stream(df: DataFrame, path: str) -> None:
    """One folder of gzip-compressed JSON lines per interaction type."""
    with settings(df.sparkSession, OPEN_FILES):
        _json_lines(df).partitionBy("interaction_type").json(path)
