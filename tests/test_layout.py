"""How the curated table is written: what is shuffled, sorted and computed once."""

import gzip

import pytest
from pyspark.sql import functions as F

from checks import base, telemetry
from promptlens.functions import detectors as D
from promptlens.operators import ledger
from promptlens.operators import curate as C
from promptlens.operators.curate import curate, dedupe_by_date, read_curated, write_curated
from promptlens.operators.deidentify import inspect
from promptlens.schema import curated_schema
from promptlens.session import SETTINGS, SMALL_TASKS, prepare, settings
from promptlens.streaming import stream


def _plan(df) -> str:
    with settings(df.sparkSession, {"spark.sql.debug.maxToStringFields": "10000"}):
        return df._jdf.queryExecution().optimizedPlan().toString()


def test_judged_columns_are_derived_after_the_last_shuffle(spark, sf):
    rows = curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark), distinct=dedupe_by_date)
    above, below = _plan(rows).split("RebalancePartitions", 1)
    assert "prompt_coaching" in above and "prompt_coaching" not in below


def test_rows_dealt_before_the_judge_are_the_same_table(spark, sf, tmp_path):
    some = base.disturbed(spark, sf).where(F.xxhash64("event_id") % 7 == 0)
    some = some.unionByName(some.limit(20))
    write_curated(curate(some, base.DETECTORS, base.test_key(spark)), f"{tmp_path}/a")
    with settings(spark, SMALL_TASKS):
        write_curated(curate(some, base.DETECTORS, base.test_key(spark), distinct=dedupe_by_date), f"{tmp_path}/b", dealt=True)
    a, b = read_curated(spark, f"{tmp_path}/a"), read_curated(spark, f"{tmp_path}/b")
    assert a.columns == b.columns and a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_text_is_lowered_once_for_all_terms(spark):
    texts = spark.createDataFrame([("A Mild CONCUSSION",), ("none",), (None,)], "prompt_text string")
    out = inspect(texts.repartition(2), base.DETECTORS)
    assert _plan(out).count("lower(") == 1 and out.columns == ["prompt_text", "dlp_info_types"]
    want = texts.select("prompt_text", D.info_types(F.col("prompt_text"), base.DETECTORS).alias("dlp_info_types"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    with settings(spark, {key: "65535"}):
        assert prepare(spark).conf.get(key) == SETTINGS[key] == "8000"


def test_settings_come_back(spark):
    before = {k: spark.conf.get(k) for k in SMALL_TASKS}
    try:
        with settings(spark, SMALL_TASKS):
            assert {k: spark.conf.get(k) for k in SMALL_TASKS} == SMALL_TASKS
            raise KeyError
    except KeyError:
        pass
    assert {k: spark.conf.get(k) for k in SMALL_TASKS} == before


@pytest.mark.parametrize("write", [C.export_jsonl, C.split_by_stream])
def test_json_lines_are_compressed_and_bounded(spark, sf, tmp_path, monkeypatch, write):
    monkeypatch.setattr(C, "EXPORT_ROWS", 300)
    rows = base.curated(spark, sf).drop("event_date").coalesce(1).withColumn("interaction_type", F.when(F.col("latency_ms") % 7 != 0, F.col("interaction_type")))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write(rows, f"{tmp_path}/out")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    files = [p for p in (tmp_path / "out").rglob("part-*")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    counts = [len(gzip.decompress(p.read_bytes()).splitlines()) for p in files]
    assert max(counts) <= 300 and sum(counts) == rows.count()
    plain = sum(len(gzip.decompress(p.read_bytes())) for p in files)
    assert sum(p.stat().st_size for p in files) < plain / 5
    back = spark.read.schema(curated_schema()).json(f"{tmp_path}/out")
    columns = [F.to_json(c).alias(c) if back.schema[c].dataType.typeName() == "struct" else c for c in back.columns]
    a, b = rows.select(*columns), back.select(*columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_load_derives_judged_columns_after_the_last_shuffle(spark, sf, tmp_path, monkeypatch):
    plans, tasks = [], []

    def write(df, *args, **options):
        plans.append(_plan(df))
        tasks.append({k: spark.conf.get(k) for k in SMALL_TASKS})
        write_curated(df, *args, **options)

    monkeypatch.setattr(ledger, "write_curated", write)
    some = base.disturbed(spark, sf).where(F.xxhash64("event_id") % 5 == 0)
    want = curate(some, base.DETECTORS, base.test_key(spark))
    assert stream.backfill(some, base.DETECTORS, base.test_key(spark), f"{tmp_path}/t") == want.count() > 0
    above, below = plans[0].split("RebalancePartitions")  # once: rows already dealt stay where they are
    assert "prompt_coaching" in above and "prompt_coaching" not in below
    assert tasks == [SMALL_TASKS]
    got = read_curated(spark, f"{tmp_path}/t").drop("event_date")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_disturbed_messages_are_put_together_once(spark):
    """Each delivery's JSON is made once, and a change that spoils it doesn't repeat those before it."""
    rows = [(i, None, i % 3, '{"k": 1}') for i in (0, 1, 50, 227, 997, 50 * 227 * 229)] + [(None, None, None, None)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, props string")
    out = telemetry.disturbed_messages(events)
    plan = _plan(out)
    assert plan.count("StructsToJsonEvaluator(") == 2
    assert plan.count("direct call") == 1 and plan.count("soon") == 1
    assert out.count() == 7 + 3
    assert sorted(r.event_id for r in out.where("event_id like 'again%'").collect()) == ["again-0", f"again-{50 * 227 * 229}", "again-50"]
