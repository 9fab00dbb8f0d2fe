"""Compaction: few files, clustered over a date, safe for readers and after failures."""

import pytest
from pyspark.sql import functions as F

from checks import base
from promptlens.operators import compact as K
from promptlens.operators import curate as C
from promptlens.operators.ledger import append_once
from promptlens.schema import CLUSTER_KEYS
from promptlens.session import scratch_path


@pytest.fixture
def table(spark, sf):
    """Three dates, appended in a dozen batches."""
    path = scratch_path(spark, "table")
    rows = base.curated(spark, sf).drop("event_date").withColumn("event_timestamp", F.timestamp_seconds(F.lit(1_767_225_600) + F.pmod(F.xxhash64("insert_id"), F.lit(3)) * 86_400))
    for i in range(12):
        C.write_curated(rows.where(F.pmod(F.xxhash64("insert_id", F.lit(1)), F.lit(12)) == i), path, "append")
    return path


def content(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def shape(spark, path):
    return {str(r.event_date): r.files for r in K.files(spark, path).collect()}


def test_few_files_and_the_same_rows(spark, table):
    before = content(C.read_curated(spark, table))
    assert min(shape(spark, table).values()) > K.MOST_FILES
    early = C.read_curated(spark, table)  # a reader that began before
    assert len(K.compact(spark, table)) == 3
    assert max(shape(spark, table).values()) <= 3 and K.compact(spark, table) == []
    assert content(C.read_curated(spark, table)) == before == content(early)
    K.vacuum(spark, table)
    assert content(C.read_curated(spark, table)) == before and spark.read.parquet(f"{table}/{C.COMPACTED}").count() == len(before)
    assert C.read_curated(spark, table).where("event_date = '2026-01-02'").count() > 0


def test_key_ranges_of_files_overlap_little(spark, table):
    def overlaps(path):
        rows = spark.read.parquet(path).withColumn("key", F.concat_ws("|", *CLUSTER_KEYS, "insert_id"))
        files = rows.groupBy("event_date", "_metadata.file_path").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
        return sum(a.event_date == b.event_date and a.low < b.low <= a.high for a in files for b in files)

    before = overlaps(table)
    K.compact(spark, table, list(shape(spark, table)), file_bytes=20_000)
    assert 3 < sum(shape(spark, table).values()) <= 60
    assert before > 100 and overlaps(f"{table}/{C.COMPACTED}") == 0


def test_appends_after_a_compaction_are_read_and_merged(spark, sf, table):
    n = C.read_curated(spark, table).count()
    K.compact(spark, table)
    assert append_once(C.read_curated(spark, table).drop("event_date"), table) == 0  # every id is known
    more = base.curated(spark, sf).drop("event_date").limit(30).withColumn("insert_id", F.concat(F.lit("new-"), "insert_id"))
    assert append_once(more, table) == 30 and C.read_curated(spark, table).count() == n + 30
    assert len(K.compact(spark, table, list(shape(spark, table)))) == len(shape(spark, table)) > 3
    K.vacuum(spark, table)
    out = C.read_curated(spark, table)
    assert out.count() == out.select("insert_id").distinct().count() == n + 30


def test_a_compaction_that_broke_off_is_not_read(spark, table, monkeypatch):
    before = content(C.read_curated(spark, table))
    with monkeypatch.context() as patch:
        def fails(*_):
            raise OSError("lost the connection")

        patch.setattr(K, "touch_file", fails)
        with pytest.raises(OSError):
            K.compact(spark, table)
    assert content(C.read_curated(spark, table)) == before
    K.vacuum(spark, table)
    assert content(C.read_curated(spark, table)) == before
    K.compact(spark, table)
    K.vacuum(spark, table)
    assert content(C.read_curated(spark, table)) == before


def test_dates_are_still_pruned(spark, table):
    K.compact(spark, table)
    plan = C.read_curated(spark, table).where("event_date = '2026-01-02' and interaction_type = 'x'")._jdf.queryExecution().toString()
    assert plan.count("EqualTo(interaction_type,x)") == 2
    scans = [x for x in plan[plan.index("== Physical Plan"):].splitlines() if "FileScan" in x]
    assert len(scans) == 2 and not any("PartitionFilters: []" in x for x in scans)
