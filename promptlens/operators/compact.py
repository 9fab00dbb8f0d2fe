"""Merging a table's small files, clustered over all files of a date, while it is read.

A compaction writes the rows of a date anew, range-partitioned and sorted by the cluster keys, and then makes one
file name that says so: from then on :func:`promptlens.operators.curate.read_curated` reads the merged files and what was added
since. Nothing is deleted before :func:`vacuum`, so readers that began earlier end well. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.operators.curate import COMPACTED, compacted_dates, read_curated, table_parts
from promptlens.schema import CLUSTER_KEYS
from promptlens.session import file_names, file_times, remove_file, touch_file

#: Bytes of a merged file, about, and how many files a date may have before it is merged.
FILE_BYTES = 256 << 20
MOST_FILES = 8


def files(spark: SparkSession, path: str) -> DataFrame:
    """(event_date, files, bytes, newest): the files that make up each date now; only footers are read."""
    columns = "event_date", "_metadata.file_path", "_metadata.file_size", F.unix_millis("_metadata.file_modification_time").alias("at")
    one = reduce(DataFrame.unionByName, (part.select(*columns) for part in table_parts(spark, path))).distinct()
    return one.groupBy("event_date").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.max("at").alias("newest"))


def compact(spark: SparkSession, path: str, dates: Sequence[str] | None = None, most_files: int = MOST_FILES, file_bytes: int = FILE_BYTES) -> list[str]:
    """Merge the given dates, or those that have more files than ``most_files`` and than their bytes ask for; returns them.

    Ranges come from sampled quantiles of date and cluster keys, so files of a date overlap in few key values; rows of equal
    keys, if very many, are parted by id. Can be repeated after any failure: what a broken-off run wrote is never read.
    """
    need = F.ceil(F.col("bytes") / file_bytes)
    wanted = (F.col("files") > most_files) & (F.col("files") > 2 * need) if dates is None else F.col("event_date").cast("string").isin(list(dates))
    due = files(spark, path).where(wanted).withColumn("need", need).collect()  # a row a date
    if not due:
        return []
    run, keys = f"r{uuid.uuid4().hex[:12]}", ["event_date", *CLUSTER_KEYS, "insert_id"]
    rows = read_curated(spark, path).where(F.col("event_date").isin([r["event_date"] for r in due]))
    laid = rows.repartitionByRange(sum(r["need"] for r in due), *keys).sortWithinPartitions(*keys)
    laid.withColumn("run", F.lit(run)).write.mode("append").partitionBy("event_date", "run").parquet(f"{path}/{COMPACTED}")
    before = compacted_dates(spark, path)
    for r in due:
        date = str(r["event_date"])
        touch_file(spark, f"{path}/{COMPACTED}/_done/{date}.{run}.{max(r['newest'], before.get(date, ('', -1))[1] + 1)}")
    return sorted(str(r["event_date"]) for r in due)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove files that compactions replaced, and those of compactions that broke off. To be called when no reader is left that
    began before the last compaction."""
    dates = compacted_dates(spark, path)
    for name in file_names(spark, f"{path}/{COMPACTED}/_done"):
        date, run, cutoff = name.split(".")
        if dates[date] != (run, int(cutoff)):
            remove_file(spark, f"{path}/{COMPACTED}/_done/{name}")
    for folder in file_names(spark, f"{path}/{COMPACTED}"):
        if folder.startswith("event_date="):
            for run in file_names(spark, f"{path}/{COMPACTED}/{folder}"):
                if dates.get(folder.split("=")[1], ("",))[0] != run.split("=")[-1]:
                    remove_file(spark, f"{path}/{COMPACTED}/{folder}/{run}")
    for date, (_, cutoff) in dates.items():
        for name, at in file_times(spark, f"{path}/event_date={date}"):
            if at <= cutoff:
                remove_file(spark, f"{path}/event_date={date}/{name}")
