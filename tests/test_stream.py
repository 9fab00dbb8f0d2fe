"""Streams: equal to batch, safe under redelivery, restart and failure."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks import base, streams
from promptlens.operators.audit import run_counters
from promptlens.operators.counters import STORED, Loaded, Totals, kept, observe
from promptlens.operators.curate import curate, curate_and_reject, read_curated
from promptlens.session import scratch_path
from promptlens.sources.logs import message_stream
from promptlens.streaming import stream as S


def parts(spark, sf, n, disturbed=False):
    """The messages as n files that arrive one after the other."""
    rows = (base.disturbed if disturbed else base.messages)(spark, sf)
    return [rows.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i) for i in range(n)]


def ids(table):
    return sorted(r.insert_id for r in table.select("insert_id").collect())


def test_stream_equals_batch_over_restarts(spark, sf):
    source, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    key = base.test_key(spark)
    for part in parts(spark, sf, 3):
        part.coalesce(1).write.mode("append").json(source)
        S.stream_curate(message_stream(spark, source, max_files=1), base.DETECTORS, key, path, state).awaitTermination()
    batch = curate(base.messages(spark, sf), base.DETECTORS, key)
    got = spark.read.parquet(path).drop("event_date").select(*batch.columns)
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0


def test_redelivered_files_add_no_rows(spark, sf):
    source, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    key = base.test_key(spark)
    for part in parts(spark, sf, 2, disturbed=True) * 2:
        part.coalesce(1).write.mode("append").json(source)
        S.stream_curate(message_stream(spark, source), base.DETECTORS, key, path, state).awaitTermination()
    want = ids(curate(base.disturbed(spark, sf), base.DETECTORS, key))
    assert ids(read_curated(spark, path)) == want


def test_a_later_copy_with_another_time_is_dropped(spark, sf):
    source, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    key = base.test_key(spark)
    for prefix in ("msg", "again"):
        base.disturbed(spark, sf).where(F.col("event_id").startswith(prefix)).coalesce(1).write.mode("append").json(source)
        S.stream_curate(message_stream(spark, source), base.DETECTORS, key, path, state).awaitTermination()
    got = ids(read_curated(spark, path))
    assert len(got) == len(set(got))


def test_failing_sink_fails_the_query_and_a_restart_repeats_the_batch(spark, sf):
    source, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    base.messages(spark, sf).write.json(source)
    key = base.test_key(spark)

    def broken(batch):
        raise RuntimeError("sink is down")

    with pytest.raises(StreamingQueryException):
        S.stream_curate(
            message_stream(spark, source), base.DETECTORS, key, path, state, curate_batch=broken
        ).awaitTermination()
    S.stream_curate(message_stream(spark, source), base.DETECTORS, key, path, state).awaitTermination()
    assert read_curated(spark, path).count() == 1000


def test_distinct_actors_on_a_stream(spark, sf):
    source = scratch_path(spark, "in")
    base.curated(spark, sf).select("event_timestamp", "anonymous_actor_hash").write.parquet(source)
    rows = spark.readStream.schema("event_timestamp timestamp, anonymous_actor_hash string").parquet(source)
    path, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    S.unique_actors_stream(rows, delay="1 hour").writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", state
    ).trigger(availableNow=True).start().awaitTermination()
    days = spark.read.parquet(path)
    assert days.count() > 20 and days.agg(F.max("actors")).first()[0] <= 15


def noting(folder, stub):
    """A judge that leaves a note of each text it is asked about."""

    def build():
        import hashlib
        import os

        answer = stub()

        def ask(texts):
            for t in texts:
                with open(os.path.join(folder, hashlib.sha256(t.encode()).hexdigest()), "a") as notes:
                    notes.write("asked\n")
            return answer(texts)

        return ask

    return build


def asked(folder):
    return {f.name: len(f.read_text().split()) for f in folder.iterdir()}


def test_a_judge_on_a_stream_names_all_rejects_and_is_asked_once(spark, sf, tmp_path):
    """Redeliveries, a restart without checkpoint and a back-fill: valid answers are asked for once, invalid ones twice."""
    from checks.judging import stub_factory

    notes = tmp_path / "asked"
    notes.mkdir()
    judge = S.Judge(noting(str(notes), stub_factory()))
    path, key = scratch_path(spark, "out"), base.test_key(spark)
    for attempt in range(2):
        source = message_stream(spark, base.disturbed_path(spark, sf), fmt="parquet")
        S.stream_curate(source, base.DETECTORS, key, path, scratch_path(spark, "state"), judge=judge).awaitTermination()
    S.backfill(base.disturbed(spark, sf), base.DETECTORS, key, path, judge)
    stored = set(ids(read_curated(spark, path)))
    lost = S.read_rejects(spark, path)
    invalid = {r.insert_id for r in lost.where("reason = 'invalid judgement after 2 attempts'").collect()}
    want = set(ids(curate(base.disturbed(spark, sf), base.DETECTORS, key)))
    assert stored and invalid and not stored & invalid and stored | invalid == want
    per_load = lost.where("not reason like 'invalid judgement%'").groupBy("origin", "event_id", "reason").count()
    _, bad = curate_and_reject(base.disturbed(spark, sf), base.DETECTORS, key)
    named = {(r.event_id, r.reason) for r in bad.collect()}
    loads = {}
    for r in per_load.collect():
        loads.setdefault(r.origin, set()).add((r.event_id, r.reason))
    assert len(loads) == 3 and all(x == named for x in loads.values())
    counts = asked(notes)
    assert set(counts.values()) == {1, 2}
    assert len(counts) <= len(stored | invalid) and list(counts.values()).count(2) <= len(invalid)


def test_a_restart_after_answers_were_stored_asks_nothing_again(spark, sf, tmp_path, monkeypatch):
    from checks.judging import stub_factory

    notes = tmp_path / "asked"
    notes.mkdir()
    judge = S.Judge(noting(str(notes), stub_factory()))
    path, state, key = scratch_path(spark, "out"), scratch_path(spark, "state"), base.test_key(spark)
    source = message_stream(spark, base.messages_path(spark, sf), fmt="parquet")
    with monkeypatch.context() as patch:
        def fails(*_, **__):
            raise RuntimeError("sink is down")

        patch.setattr(S, "append_staged", fails)
        with pytest.raises(StreamingQueryException):
            S.stream_curate(source, base.DETECTORS, key, path, state, judge=judge).awaitTermination()
    before = asked(notes)
    S.stream_curate(source, base.DETECTORS, key, path, state, judge=judge).awaitTermination()
    assert before and asked(notes) == before and read_curated(spark, path).count() > 0


def test_rejects_are_kept_by_default_and_replaced_by_a_repeated_batch(spark, sf):
    path, key = scratch_path(spark, "out"), base.test_key(spark)
    for _ in range(2):
        S.backfill(base.disturbed(spark, sf), base.DETECTORS, key, path, name="june")
    _, bad = curate_and_reject(base.disturbed(spark, sf), base.DETECTORS, key)
    got = S.read_rejects(spark, path)
    assert sorted(map(str, got.select("event_id", "insert_id", "reason").collect())) == sorted(map(str, bad.collect()))
    assert read_curated(spark, path).count() == len(set(ids(curate(base.disturbed(spark, sf), base.DETECTORS, key))))


def test_totals_come_from_the_writes(spark, sf):
    """Two micro-batches with redeliveries and a back-fill: their totals add up to those of one batch."""
    files = scratch_path(spark, "in")
    for part in parts(spark, sf, 2, disturbed=True):
        part.coalesce(1).write.mode("append").json(files)
    path, key = scratch_path(spark, "out"), base.test_key(spark)
    S.stream_curate(message_stream(spark, files, max_files=1), base.DETECTORS, key, path, scratch_path(spark, "state")).awaitTermination()
    assert S.backfill(base.disturbed(spark, sf), base.DETECTORS, key, path, name="all") == 0
    rows, bad = curate_and_reject(base.disturbed(spark, sf), base.DETECTORS, key)
    want = run_counters(rows).first()
    loads = kept(spark, path)
    got = loads.where("origin != 'backfill'").agg(*(F.sum(c).alias(c) for c in Loaded.__dataclass_fields__)).first()
    assert (got.stored, got.flagged, got.ssn, got.toxic) == (want.total_rows, want.flagged_rows, want.ssn_rows, want.toxic_rows)
    assert (got.malformed, got.rejected) == (bad.where("reason = 'malformed'").count(), bad.where("reason != 'malformed'").count())
    assert got.delivered == base.disturbed(spark, sf).where("length(data) > 0").count() and loads.count() == 3
    assert loads.where("origin = 'backfill'").first().stored == 0


def test_a_listener_sums_what_a_stream_observes(spark, sf):
    source = scratch_path(spark, "in")
    base.curated(spark, sf).repartition(4).write.parquet(source)
    totals = Totals("rows")
    spark.streams.addListener(totals)
    try:
        rows = spark.readStream.schema(base.curated(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = observe(rows, STORED, "rows").writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if totals.totals().get("stored") == 1000:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    want = run_counters(base.curated(spark, sf)).first()
    assert totals.totals() == {"stored": want.total_rows, "flagged": want.flagged_rows, "ssn": want.ssn_rows, "toxic": want.toxic_rows}


def test_more_messages_make_more_files_not_more_batches(spark, tmp_path, monkeypatch):
    """A task reads a file, so files are of a size; a micro-batch takes as many as there are."""
    path = f"{tmp_path}/messages"
    spark.range(4000).selectExpr("'msg-' || id AS event_id", "sha2(CAST(id AS string), 512) AS data").write.parquet(path)
    monkeypatch.setattr(streams, "FILE_BYTES", 20_000)
    source = streams._file_stream(spark, path, "many-files", 3)
    seen = []
    query = source.writeStream.foreachBatch(lambda b, n: seen.append((b.count(), b.select(F.input_file_name()).distinct().count()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == 3 and sum(n for n, _ in seen) == 4000
    assert min(files for _, files in seen) > 1


def test_events_are_spread_by_their_size(spark):
    rows = spark.range(10)
    assert base.spread(rows, 100 * base.SPREAD_BYTES).rdd.getNumPartitions() == 100
    assert base.spread(rows.repartition(200), 100 * base.SPREAD_BYTES).rdd.getNumPartitions() == 200
