"""Registry of checked queries and the frames they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.telemetry_sql import TEST_SEED
from promptlens.functions import detectors as D
from promptlens.functions.hashing import ActorKey, derive_key, key_table
from promptlens.operators.curate import curate, dedupe_by_date, masked_rows, read_curated, write_curated
from promptlens.operators.normalize import flatten
from promptlens.session import SMALL_TASKS, prepare, scratch_path, settings
from checks import telemetry as T
from promptlens.sources.logs import decode_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DETECTORS = D.default_detectors(T.SUBJECT_NAMES)


def check(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the SQL it must equal."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return register


def test_key(spark: SparkSession) -> ActorKey:
    return ActorKey(key_table(spark, derive_key(TEST_SEED)))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return T.read_events(prepare(spark), sf)


_tables: dict[tuple, str] = {}


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_once(spark: SparkSession, sf: str, kind: str, write: Callable[[str], None]) -> str:
    """Path of a table derived from the events, written once per session to the shared
    folder. A changed input (size or time) is derived anew."""
    p, fs = _file(spark, f"{sf}/events.parquet")
    version = fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()
    known = (spark.sparkContext.applicationId, kind, sf, *version)
    path = _tables.get(known)
    if path is not None:
        folder, fs = _file(spark, path)
        if fs.exists(folder):
            return path
    path = scratch_path(spark, kind)
    write(path)
    _tables[known] = path
    return path


#: Bytes of events whose messages one task derives, about: they are twenty times as large.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame, size: int = 0) -> DataFrame:
    """Use all cores where a small input comes as one split, and a task for so many of the input's ``size`` bytes; an input
    that comes in more splits stays as read."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _spread_events(spark: SparkSession, sf: str) -> DataFrame:
    p, fs = _file(spark, f"{sf}/events.parquet")
    return spread(events(spark, sf), fs.getContentSummary(p).getLength())


def messages_path(spark: SparkSession, sf: str) -> str:
    """Folder of message envelopes, as a log sink would leave them."""
    return written_once(
        spark, sf, "messages",
        lambda path: T.messages(_spread_events(spark, sf)).write.parquet(path),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).read.parquet(messages_path(spark, sf))


def disturbed_path(spark: SparkSession, sf: str) -> str:
    return written_once(
        spark, sf, "disturbed",
        lambda path: T.disturbed_messages(_spread_events(spark, sf)).write.parquet(path),
    )


def disturbed(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).read.parquet(disturbed_path(spark, sf))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return decode_messages(messages(spark, sf))


def flat(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(entries(spark, sf))


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Flat rows of the disturbed messages that decode."""
    return flatten(decode_messages(disturbed(spark, sf)))


def masked(spark: SparkSession, sf: str) -> DataFrame:
    return masked_rows(entries(spark, sf), DETECTORS, test_key(spark))


def curated(spark: SparkSession, sf: str) -> DataFrame:
    """The curated table; each report scans only the columns it needs."""

    def write(path: str) -> None:
        rows = curate(messages(spark, sf), DETECTORS, test_key(spark), distinct=dedupe_by_date)
        with settings(spark, SMALL_TASKS):
            write_curated(rows, path, dealt=True)

    return read_curated(prepare(spark), written_once(spark, sf, "curated", write))


def stamp(col: str = "event_timestamp", name: str | None = None) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSS").alias(name or col)


def joined(col: str | Column, name: str | None = None) -> Column:
    expr = F.col(col) if isinstance(col, str) else col
    out = F.array_join(expr, ",")
    return out.alias(name or col)  # type: ignore[arg-type]
