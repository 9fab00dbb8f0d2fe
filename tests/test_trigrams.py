"""Files that cannot hold a substring are skipped; the rows are those of a whole scan."""

import pytest
from pyspark.sql import functions as F

from checks import base
from promptlens.operators import curate as C
from promptlens.operators import trigrams as G
from promptlens.plans.reports import mentions
from promptlens.session import scratch_path
from tests.test_plans import nodes


@pytest.fixture(scope="module")
def path(spark, sf):
    """One file for each of ten entities."""
    path = scratch_path(spark, "entities")
    names = F.array(*map(F.lit, ["Line 3 (ERR-PLC-409) / Lot #402", "Line 30", "Lot #517", "Gate 7", "日本 line", "", "Dock 12", "ABA", "Press 9", "Press 8"]))
    n = F.pmod(F.xxhash64("insert_id"), F.lit(10))
    rows = base.curated(spark, sf).drop("event_date").withColumn("operational_entity", F.when(n == 5, F.lit(None)).otherwise(F.get(names, n.cast("int"))))
    rows = rows.withColumn("event_timestamp", F.timestamp_seconds(F.lit(1_767_225_600) + n * 86_400)).withColumn("operational_entity", F.coalesce("operational_entity", F.lit("")))
    C.write_curated(rows, path)
    G.index_files(spark, path)
    return path


def files_read(df):
    df.collect()
    return sum(n.metrics().apply("numFiles").value() for n in nodes(df) if n.nodeName().startswith("Scan parquet"))


@pytest.mark.parametrize("terms,files", [(["Line 3", "Lot #402"], 2), (["Press"], 2), (["本 l"], 1), (["nowhere"], 0), (["e 3", "Dock"], 3), (["7"], 10), (["BAB"], 0)])
def test_rows_of_a_scan_from_few_files(spark, path, terms, files):
    got = G.holding(spark, path, terms)
    want = C.read_curated(spark, path).where(mentions(F.col("operational_entity"), terms))
    assert sorted(r.insert_id for r in got.select("insert_id").collect()) == sorted(r.insert_id for r in want.select("insert_id").collect())
    total = C.read_curated(spark, path).select("_metadata.file_path").distinct().count()
    assert total == 10 and len(G.skipped(spark, path, "operational_entity", terms)) == 10 - files
    assert files_read(got.select("insert_id")) == files


def test_files_added_since_are_read_and_then_indexed_once(spark, sf, path):
    copy = scratch_path(spark, "copy")
    C.write_curated(C.read_curated(spark, path).drop("event_date"), copy)
    assert G.skipped(spark, copy, "operational_entity", ["Gate"]) == []  # no index yet
    G.index_files(spark, copy)
    before = spark.read.parquet(f"{copy}/_trigrams").count()
    more = base.curated(spark, sf).drop("event_date").limit(5).withColumn("operational_entity", F.lit("Gate 99"))
    C.write_curated(more, copy, "append")
    assert G.holding(spark, copy, ["Gate 99"]).count() == 5
    G.index_files(spark, copy)
    after = spark.read.parquet(f"{copy}/_trigrams").count()
    G.index_files(spark, copy)
    assert before < after == spark.read.parquet(f"{copy}/_trigrams").count()
    assert G.holding(spark, copy, ["Gate 99"]).count() == 5
