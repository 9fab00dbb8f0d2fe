"""Bounded stream state: windows close, late rows are counted, nothing is lost."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from promptlens.operators import runs as R
from promptlens.session import file_names, scratch_path
from promptlens.streaming import bounded as B

KIND = "insert_id string, event_timestamp timestamp, trace_id string, span_id string, pillar string, dlp_detected boolean, contains_ssn boolean, is_toxic_combination boolean"
START = dt.datetime(2026, 1, 1)


def row(n, hours, pillar="HR"):
    return (f"id-{n}", START + dt.timedelta(hours=hours), "t", "s", pillar, n % 2 == 0, n % 3 == 0, None)


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def counts(df):
    return {(str(r.window_start), r.pillar): tuple(r[c] for c in B.COUNTS) for r in df.collect()}


def truth(rows):
    first = {}
    for r in rows:
        first.setdefault(r[0], r)
    out = {}
    for r in first.values():
        key = (str(r[1].replace(minute=0, second=0, microsecond=0)), r[4])
        old = out.get(key, (0, 0, 0, 0))
        out[key] = tuple(a + b for a, b in zip(old, (1, r[5], r[6], 0)))
    return out


@pytest.fixture
def small_merges(monkeypatch):
    monkeypatch.setattr(R, "FANOUT", 3)


def test_state_stays_small_windows_close_and_late_rows_are_settled(spark, small_merges):
    rng, counters = random.Random(3), B.BoundedCounters(scratch_path(spark, "counters"), delay="3 hours")
    every, sizes, emitted = [], [], []
    for batch in range(11):
        rows = [row(100 * batch + i, batch + rng.random(), rng.choice(["HR", "Ops"])) for i in range(12)]
        rows += rng.sample(every, min(len(every), 4)) if batch % 3 else every[-6:]  # redeliveries, old and new
        if batch in (6, 9):
            rows.append(row(100 * batch + 50, 0.5))  # a first delivery six and nine hours late
        every += rows
        counters.add(table(spark, rows), batch)
        seen = B.Seen(spark, f"{counters.path}/seen", batch)
        sizes.append(seen.rows().count() + counters.open(spark).count())
        closed = counters.closed(spark).select("window_start", "pillar").collect()
        assert len(closed) == len(set(closed))
        emitted.append(len(closed))
    assert max(sizes[6:]) <= 1.5 * max(sizes[:6])  # no growth with the stream
    assert emitted[-1] > emitted[5] > 0
    late = counters.late(spark).collect()
    assert {"id-650", "id-950"} <= {r.insert_id for r in late}
    by_table = table(spark, list({r[0]: r for r in reversed(every)}.values())).withColumn("event_date", F.to_date("event_timestamp"))
    assert counts(counters.settled(by_table)) == truth(every)
    assert len(file_names(spark, f"{counters.path}/open")) <= 3


def test_a_repeated_batch_changes_nothing(spark, monkeypatch):
    counters = B.BoundedCounters(scratch_path(spark, "counters"), delay="2 hours")
    rows = [[row(i, i / 4) for i in range(12)], [row(i, i / 4) for i in range(6, 20)]]
    counters.add(table(spark, rows[0]), 0)
    with monkeypatch.context() as patch:
        def fails(*_):
            raise OSError("lost the connection")

        patch.setattr(B, "touch_file", fails)  # everything is written but the batch's end
        with pytest.raises(OSError):
            counters.add(table(spark, rows[1]), 1)
    for _ in range(2):
        counters.add(table(spark, rows[1]), 1)
    assert counts(counters.closed(spark).unionByName(counters.open(spark))) == truth(rows[0] + rows[1])


def test_empty_batches_and_rows_without_flags(spark):
    counters = B.BoundedCounters(scratch_path(spark, "counters"))
    counters.add(table(spark, []), 0)
    counters.add(table(spark, [("a", START, None, None, None, None, None, None)]), 1)
    assert counts(counters.open(spark)) == {(str(START), None): (1, 0, 0, 0)}
    assert counters.late(spark).count() == 0 and counters.closed(spark).count() == 0
