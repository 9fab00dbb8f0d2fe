"""Raw log entries: JSON-lines files, message envelopes, routing and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions import payload as P
from promptlens.schema import CORRUPT, LOG_ENTRY, strict_entry

STREAMS = {"chat": V.CHAT_STREAM, "agent": V.AGENT_STREAM}


def parse_entry(text: Column, strict: bool = False) -> Column:
    """JSON text to a log entry; undecodable text keeps its raw form in the corrupt field. A ``strict`` entry tells a
    null from an absent field where that matters."""
    return F.from_json(
        text, strict_entry() if strict else LOG_ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )


def is_corrupt(entry: Column) -> Column:
    return entry.isNull() | entry[CORRUPT].isNotNull()


def read_log_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One log entry per line, read as text first so that bad lines survive: (raw, entry)."""
    return spark.read.text(path).select(
        F.col("value").alias("raw"), parse_entry(F.col("value")).alias("entry")
    )


def stamp_stream(df: DataFrame, stream: str) -> DataFrame:
    """Assign the stream a file belongs to; whatever name the entry carries is replaced."""
    return df.withColumn("log_name", F.lit(stream))


def read_streams(spark: SparkSession, paths: dict[str, str], source: str = "all") -> DataFrame:
    """Read one or both raw streams from ``{"chat": path, "agent": path}``."""
    if source not in ("all", *STREAMS):
        raise ValueError(f"source must be all, chat or agent, not {source!r}")
    chosen = [s for s in STREAMS if source in ("all", s)]
    parts = [stamp_stream(read_log_jsonl(spark, paths[s]), STREAMS[s]) for s in chosen]
    return parts[0] if len(parts) == 1 else union_streams(*parts)


def union_streams(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both streams as one; columns only one side has become null on the other."""
    return left.unionByName(right, allowMissingColumns=True)


def drop_empty_messages(messages: DataFrame) -> DataFrame:
    """Messages without data are skipped, not failed."""
    return messages.where(F.coalesce(F.octet_length("data"), F.lit(0)) > 0)


def message_text(data: Column) -> Column:
    """Base64 message data to text; data that isn't base64 of valid UTF-8 gives null."""
    return F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))


def decode_messages(messages: DataFrame, strict: bool = False) -> DataFrame:
    """(event_id, data) to (event_id, entry), malformed rows dropped.

    The parsed entry passes through a generator, so that it is parsed once:
    a plain filter on it would be pushed below and parse every text twice.
    """
    entries = F.filter(
        F.array(parse_entry(message_text(F.col("data")), strict)), lambda e: ~is_corrupt(e)
    )
    return drop_empty_messages(messages).select("event_id", F.explode(entries).alias("entry"))


def quarantine_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split messages into decoded entries and the envelopes that do not decode.

    Quarantined rows keep only id, size and digest: their text may hold
    unmasked data. The envelope itself can be fetched again by its id.
    """
    entry = parse_entry(message_text(F.col("data")))
    bad = drop_empty_messages(messages).where(is_corrupt(entry)).select(
        "event_id",
        F.length("data").alias("data_length"),
        F.sha2("data", 256).alias("data_sha256"),
        F.lit("malformed").alias("reason"),
    )
    return decode_messages(messages), bad


def route_logs(df: DataFrame, names: tuple[str, ...] = (V.CHAT_STREAM, V.AGENT_STREAM)) -> DataFrame:
    """Keep entries of the named streams, given as bare names or full resource paths."""
    bare = F.substring_index("log_name", "/", -1)
    return df.where(bare.isin(*names) | F.col("log_name").isin(*names))


def labels(payload: Column, tag: tuple[str, str] = ("telemetry", "prompt-analytics")) -> Column:
    """Label map of an entry; ``tag`` is the fixed label every entry gets."""
    kind = payload["interaction_type"]
    return F.create_map(
        F.lit(tag[0]), F.lit(tag[1]),
        F.lit("interaction_type"), P.field_or(kind, "UNKNOWN"),
        F.lit("simulated_service"),
        F.when(kind == V.CHAT, V.CHAT_SERVICE).otherwise(V.AGENT_SERVICE),
        F.lit("pillar"), P.field_or(payload["pillar"], "Unknown"),
        F.lit("plant_location"), P.field_or(payload["plant_location"], "Unknown"),
    )


def attach_labels(df: DataFrame, tag: tuple[str, str] = ("telemetry", "prompt-analytics")) -> DataFrame:
    return df.withColumn("labels", labels(F.col("entry.jsonPayload"), tag))


MAX_FILES = 1000


def message_stream(spark: SparkSession, path: str, max_files: int = MAX_FILES, fmt: str = "json") -> DataFrame:
    """Streaming (event_id, data) from files of envelopes; ``max_files`` per batch is the
    back-pressure knob, so a backlog comes in several batches."""
    reader = spark.readStream.schema("event_id string, data string").format(fmt)
    return reader.option("maxFilesPerTrigger", max_files).load(path)
