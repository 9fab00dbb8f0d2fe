"""The ledger of loaded ids: what an append reads, merges, and settles after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from checks import base
from promptlens.operators import curate as C
from promptlens.operators import ledger as L
from promptlens.operators import runs as R
from promptlens.session import file_names, scratch_path
from tests.test_plans import nodes

SCHEMA = "insert_id string, event_date date"


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def ids(spark, numbers):
    return spark.createDataFrame([(f"id-{n:06}", None) for n in numbers], SCHEMA)


@pytest.fixture
def small(monkeypatch):
    """Many buckets for few rows."""
    monkeypatch.setattr(R, "BUCKET_ROWS", 100)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def runs_of(spark, *several):
    runs = R.Runs(spark, scratch_path(spark, "runs"), "insert_id", SCHEMA)
    for numbers in several:
        runs.mark(runs.write(ids(spark, numbers), len(numbers)))
    return runs


def scans(df):
    return [n for n in nodes(df) if n.nodeName().startswith("Scan parquet")]


def test_bucket_counts(small):
    assert [R.buckets_for(n) for n in (0, 1, 100, 101, 250, 1000)] == [1, 1, 1, 2, 4, 16]


@pytest.mark.parametrize("few", [1000, 0])
def test_looking_up_and_joining_give_the_same(spark, small, monkeypatch, few):
    monkeypatch.setattr(R, "LOOKUP", few)
    runs = runs_of(spark, range(0, 3000, 3), range(1, 60, 3), range(4000, 4100))
    batch = ids(spark, range(2, 4500, 7)).union(spark.createDataFrame([(None, None)], SCHEMA))
    held = set(range(0, 3000, 3)) | set(range(1, 60, 3)) | set(range(4000, 4100))
    got = {r.insert_id for r in runs.without(batch, 700).collect()}
    assert got == {None} | {f"id-{n:06}" for n in range(2, 4500, 7) if n not in held}
    assert sorted(r.insert_id for r in runs.having(batch, 700).collect()) == [f"id-{n:06}" for n in range(2, 4500, 7) if n in held]


def test_a_large_run_is_joined_without_a_shuffle_of_its_own(spark, small, monkeypatch, no_broadcast):
    monkeypatch.setattr(R, "LOOKUP", 0)
    runs = runs_of(spark, range(1600))
    out = runs.without(ids(spark, range(5000, 6000)), 1000)
    below = [x for n in nodes(out) if "Exchange" in n.nodeName() for x in nodes_of(n)]
    assert not any(x.nodeName().startswith("Scan parquet") for x in below)
    assert any("Bucketed: true" in x.toString() for x in scans(out))


def nodes_of(node):
    todo, found = [node], []
    while todo:
        n = todo.pop()
        found.append(n)
        children = n.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return found


def rows_read(df):
    df.collect()
    return sum(n.metrics().apply("numOutputRows").value() for n in scans(df))


def test_a_small_append_reads_a_part_that_shrinks_with_its_size(spark, small):
    runs = runs_of(spark, range(0, 12800, 2))
    run = runs.live()[0]
    assert run.buckets == 64
    part = runs.read(run)

    def found(numbers):
        return rows_read(part.where(F.col("insert_id").isin([f"id-{n:06}" for n in numbers])))

    one, ten = found([4000]), found(range(4000, 4020, 2))
    assert 0 < one <= 300 and ten <= 12 * 300
    # ids that are new, as most are, end at the Bloom filters
    assert found(range(1, 12800, 128)) < 0.2 * 6400


def test_runs_of_a_size_are_merged(spark, small):
    runs = R.Runs(spark, scratch_path(spark, "runs"), "insert_id", SCHEMA)
    for i in range(20):
        runs.mark(runs.write(ids(spark, range(10 * i, 10 * i + 10)), 10))
        runs.compact()
    assert len(runs.live()) == 2 + 4 and sum(r.rows for r in runs.live()) == 200
    assert runs.rows().select("insert_id").distinct().count() == runs.rows().count() == 200
    assert len(file_names(spark, runs.path)) == len(runs.live()) + 1  # nothing else is left lying


def test_a_catalog_that_does_not_know_the_buckets(spark, small, monkeypatch, no_broadcast):
    monkeypatch.setattr(R, "LOOKUP", 0)
    runs = runs_of(spark, range(800))
    spark.sql(f"DROP TABLE {runs._table(runs.live()[0])}")  # as a catalog that doesn't know it
    again = R.Runs(spark, runs.path, "insert_id", SCHEMA)
    fresh = again.without(again.spark.createDataFrame([("id-000001", None), ("id-900000", None)], SCHEMA), 2)
    assert [r.insert_id for r in fresh.collect()] == ["id-900000"]
    assert any("Bucketed: true" in x.toString() for x in scans(fresh))


def test_a_merge_that_broke_off_loses_and_adds_nothing(spark, small, monkeypatch):
    runs = runs_of(spark, *(range(10 * i, 10 * i + 10) for i in range(R.FANOUT)))
    with monkeypatch.context() as patch:
        def fails(run):
            raise OSError("lost the connection")

        patch.setattr(runs, "drop", fails)
        with pytest.raises(OSError):
            runs.compact()
    batch = ids(spark, range(0, 200))
    assert runs.without(batch, 200).count() == 200 - 10 * R.FANOUT
    runs.compact()
    assert runs.without(batch, 200).count() == 200 - 10 * R.FANOUT


def test_random_appends_with_failures_leave_each_id_once(spark, sf, small, monkeypatch):
    """Appends of overlapping rows, some of which fail before, amid or after the table's write."""
    path, rng = scratch_path(spark, "table"), random.Random(5)
    stored = scratch_path(spark, "rows")
    C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark)).write.parquet(stored)
    rows = spark.read.parquet(stored)
    wanted: set = set()
    for step in range(6):
        part = rows.where(F.pmod(F.xxhash64("insert_id", F.lit(rng.randint(0, 3))), F.lit(5)) == rng.randint(0, 4))
        fate = rng.choice(["good", "good", "before", "after", "mark"])
        with monkeypatch.context() as patch:
            if fate in ("before", "after"):
                def fails(df, target, mode, arrived=fate == "after"):
                    if arrived:
                        C.write_curated(df, target, mode)
                    raise OSError("lost the connection")

                patch.setattr(L, "write_curated", fails)
            if fate == "mark":
                patch.setattr(R.Runs, "mark", lambda self, run: (_ for _ in ()).throw(OSError("lost the connection")))
            try:
                L.append_once(part, path, distinct=True)
            except OSError:
                pass
            else:
                wanted |= {r.insert_id for r in part.select("insert_id").collect()}
        if fate != "good":
            L.append_once(part, path, distinct=True)
            wanted |= {r.insert_id for r in part.select("insert_id").collect()}
        got = [r.insert_id for r in C.read_curated(spark, path).select("insert_id").collect()]
        assert len(got) == len(set(got)) and set(got) == wanted, (step, fate)
    assert not L.open_appends(spark, path)


@pytest.mark.parametrize("numbers, sent", [(range(0, 60, 2), True), (range(0, 600, 2), False)])
def test_only_few_keys_are_sent_to_every_task(spark, monkeypatch, static, numbers, sent):
    monkeypatch.setattr(R, "SENT", 100)
    monkeypatch.setattr(R, "LOOKUP", 0)
    runs = runs_of(spark, numbers)
    batch = ids(spark, range(900))

    def broadcasts(df):
        return [n for n in nodes(df) if n.nodeName().startswith("Broadcast")]

    out = runs.without(batch, 900)
    assert bool(broadcasts(out)) == sent
    assert out.count() == 900 - len(numbers)
    kept = runs.having(ids(spark, numbers), len(numbers))
    assert sent or not broadcasts(kept)
    assert kept.count() == len(numbers)


@pytest.mark.parametrize("known, sent", [(range(1000, 1950), True), (range(1000, 1600), False)])
def test_new_ids_of_an_append_are_sent_only_if_few(spark, sf, small, static, monkeypatch, tmp_path, known, sent):
    """Rows that are new are joined by shuffle partitions, not by the few buckets of the run that names them."""
    monkeypatch.setattr(R, "SENT", 100)
    rows = base.curated(spark, sf).limit(1).drop("insert_id").crossJoin(spark.range(1000, 2000).selectExpr("concat('id-', id) as insert_id"))
    path, seen = f"{tmp_path}/table", []
    names = base.curated(spark, sf).drop("event_date").columns
    L.append_once(rows.where(f"insert_id < 'id-{known.stop}'").select(names), path)

    def finish(new):
        seen.append([n.nodeName() for n in nodes(new)])
        seen.append(any("Bucketed: true" in x.toString() for x in scans(new)))
        return new.select(*names)

    staged = f"{tmp_path}/staged"
    rows.write.parquet(staged)
    assert L.append_staged(spark.read.parquet(staged), path, finish) == 2000 - known.stop
    assert any(n.startswith("Broadcast") for n in seen[0]) == sent and not seen[1]
    assert C.read_curated(spark, path).select("insert_id").distinct().count() == C.read_curated(spark, path).count() == 1000
