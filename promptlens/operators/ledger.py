"""Appending rows once each: a ledger of loaded ids beside the table.

The table's folder holds ``_ledger``, the ids as :class:`promptlens.operators.runs.Runs`, and ``_open``, a file name for each
append under way. Readers of the table skip both. An append that broke off has a run of ids whose rows may or
may not have arrived: the next append looks for just those ids, on just their dates. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.operators.curate import dedupe, read_curated, write_curated
from promptlens.operators.runs import Runs, joined_by
from promptlens.schema import curated_schema
from promptlens.session import SMALL_TASKS, file_names, remove_file, scratch_path, settings, touch_file

LEDGER = "insert_id string, event_date date"


def ledger(spark: SparkSession, path: str) -> Runs:
    return Runs(spark, f"{path}/_ledger", "insert_id", LEDGER)


def open_appends(spark: SparkSession, path: str) -> list[str]:
    """Appends that began and neither ended nor were settled: none, or the one that broke off."""
    return file_names(spark, f"{path}/_open")


def _missing_is_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def recover(spark: SparkSession, path: str) -> None:
    """Settle appends that broke off: ids whose rows did arrive are entered anew, the rest is free again."""
    runs = ledger(spark, path)
    live = {r.name for r in runs.live()}
    for append in open_appends(spark, path):
        if append not in live:  # else it broke off at its very end
            doubtful = _missing_is_none(lambda: spark.read.schema(LEDGER).parquet(f"{runs.path}/{append}"))
            table = _missing_is_none(lambda: read_curated(spark, path))
            if doubtful is not None and table is not None:
                dates = [r["event_date"] for r in doubtful.select("event_date").distinct().collect()]
                there = table.where(F.col("event_date").isin(dates)).select("insert_id").hint("merge")
                found = doubtful.join(there, "insert_id", "left_semi").distinct()
                count = found.count()
                if count:
                    runs.mark(runs.write(found, count))
            remove_file(spark, f"{runs.path}/{append}")
        remove_file(spark, f"{path}/_open/{append}")


def append_once(rows: DataFrame, path: str, distinct: bool = False) -> int:
    """Append the rows whose ``insert_id`` is new, and return how many there were.

    ``rows`` are computed once, into the shared folder. Can be repeated after any failure.
    ``distinct=True`` says that ids are unique within ``rows`` already.
    """
    names = curated_schema().names
    staged = scratch_path(rows.sparkSession, "staged")
    (rows if distinct else dedupe(rows)).select(*names).write.parquet(staged)
    return append_staged(rows.sparkSession.read.parquet(staged), path, lambda new: new.select(*names))


def append_staged(staged: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame], dealt: bool = False) -> int:
    """Append what ``finish`` makes of the rows whose ``insert_id`` is new, one row for each id.

    ``staged`` is read several times, so it must be a stored table. ``finish`` sees new rows only and keeps one row for
    each ``insert_id``, that of the least ``event_timestamp``. ``dealt`` says that its rows are dealt by date already; they are then
    sorted whole, by tasks that are small enough for it.
    """
    spark = staged.sparkSession
    recover(spark, path)
    runs = ledger(spark, path)
    if not runs.live() and _missing_is_none(lambda: read_curated(spark, path)) is not None:
        register(path, spark)
    ids = staged.groupBy("insert_id").agg(F.to_date(F.min("event_timestamp")).alias("event_date"))
    most = staged.count()
    append = uuid.uuid4().hex
    touch_file(spark, f"{path}/_open/{append}")
    run = runs.write(runs.without(ids, most), most, append)
    own = runs.files(run)
    count = own.count()
    if count:
        new = staged if count == most else staged.join(joined_by(own.select("insert_id"), count), "insert_id", "left_semi")
        if dealt:
            with settings(spark, SMALL_TASKS):
                write_curated(finish(new), path, "append", dealt=True)
        else:
            write_curated(finish(new), path, "append")
        runs.mark(run)
        remove_file(spark, f"{path}/_open/{append}")
        runs.compact()
    else:
        remove_file(spark, f"{path}/_open/{append}")
        runs.drop(run)
    return count


def register(path: str, spark: SparkSession) -> None:
    """Enter all ids of a table that was written without a ledger, such as one batch load."""
    runs, table = ledger(spark, path), read_curated(spark, path).select("insert_id", "event_date")
    runs.mark(runs.write(table, table.count()))
