"""Resharding of rows as they may come: null and repeated ids, equal rows on both sides of a cut."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from promptlens.llm import queries, reshard
from promptlens.session import scratch_path


def check_laws(given, rows, shards):
    """Each given (id, text) once, slots without gaps, sizes near equal; ``rows`` have id, size, crc, shard, slot."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    widest = max((r.size for r in rows), default=0)
    held = [sizes[j] for j in range(shards)]
    assert max(held) - min(held) <= 4 * widest


def test_op4_on_odd_rows(spark, documents, tmp_path):
    documents.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    given = [(r.doc_id, r.text) for r in documents.collect()]
    rows = queries.QUERIES["op4_flow_resharding"](spark, str(tmp_path)).collect()
    check_laws(given, rows, 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_op4_on_no_rows(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op4_flow_resharding"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_equal_rows_are_parted_by_number(spark, blocks):
    """A third of all rows are one row, nulls and ids that stand twice are among the others."""
    given = [(7, "same text")] * 100 + [(None, "no id")] * 40 + [(i % 90, f"text {i % 45}") for i in range(160)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5).withColumns({"shard": F.lit("mine"), "slot": F.lit(1.5), "size": F.lit(0)})
    old = F.pmod(F.hash("text"), F.lit(2))
    plan = reshard.plan(docs, old, 2, 5, blocks=blocks)
    rows = reshard.assigned(docs, plan).collect()
    check_laws(given, rows, 5)
    path = scratch_path(spark, "shards")
    kept = reshard.rewrite(docs, plan, path)
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back) == Counter(
        (r.doc_id, t, r.shard, r.slot) for r in rows if r.shard not in kept for t in {x for i, x in given if i == r.doc_id and zlib.crc32(x.encode()) == r.text_crc32}
    )


def test_a_text_moves_once(spark, sf):
    docs = queries.table(spark, sf, "documents")
    plan = reshard.plan(docs, F.pmod(F.xxhash64("source"), F.lit(12)), 12, 8)
    text = plan.place(docs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in text


def test_files_hold_bounded_ranges_of_slots(spark, sf, monkeypatch):
    monkeypatch.setattr(reshard, "FILE_BYTES", 20_000)
    docs = queries.table(spark, sf, "documents")
    plan, path = reshard.plan(docs, F.pmod(F.xxhash64("source"), F.lit(12)), 12, 8, blocks=64), scratch_path(spark, "shards")
    parts = {(r.shard, r["_part"]) for r in plan.bases.collect()}
    assert len(parts) > 20
    reshard.rewrite(docs, plan, path)
    for r in spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect():
        assert r.last == r.n - 1
