"""Sketches of days, merged for spans, against exact counts and ranks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from promptlens.plans import sketches as K
from promptlens.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    """Five days; actors come again on other days, one of them with a third of all rows; latencies are skewed."""
    n = F.col("id")
    actor = F.when(n % 3 == 0, F.lit("usr_hot")).otherwise(F.concat(F.lit("usr_"), (F.xxhash64(n) % 20_000).cast("string")))
    value = F.floor(F.pow(F.lit(1.0001), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(100_000)))).cast("bigint")
    return spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_767_225_600) + F.pmod(F.xxhash64(n, F.lit(2)), F.lit(5 * 86_400))).alias("event_timestamp"),
        actor.alias("anonymous_actor_hash"), F.when(n % 7 < 3, "HR").otherwise("Operations").alias("department"), F.lit("AGENT").alias("interaction_type"),
        F.concat(F.lit("agent"), (n % 2).cast("string")).alias("leaf_agent"), *(value.alias(m) for m in K.PERFORMANCE),
    ).cache()


def test_actors_of_any_span(spark, rows):
    path = scratch_path(spark, "actors")
    K.write_sketches(K.actor_sketches(rows), path)
    stored = spark.read.parquet(path)
    for days in (1, 3, 5):
        upto = dt.date(2026, 1, 1) + dt.timedelta(days=days)
        exact = {r.department: (r.n, r.a) for r in rows.where(F.to_date("event_timestamp") < upto).groupBy("department").agg(F.count("*").alias("n"), F.countDistinct("anonymous_actor_hash").alias("a")).collect()}
        got = {r.unit: (r.prompts, r.actors) for r in K.distinct_actors(stored.where(F.col("event_date") < upto)).collect()}
        for unit, (n, actors) in exact.items():
            assert got[unit][0] == n and abs(got[unit][1] - actors) <= 0.04 * actors
    whole = K.distinct_actors(stored, by=()).first()
    exact = rows.select("anonymous_actor_hash").distinct().count()
    assert abs(whole.actors - exact) <= 0.04 * exact


def test_percentiles_of_any_span(spark, rows):
    path = scratch_path(spark, "performance")
    K.write_sketches(K.performance_sketches(rows), path)
    stored = spark.read.parquet(path).where("event_date < '2026-01-04'")
    part = rows.where("event_timestamp < '2026-01-04'")
    for r in K.performance_of(stored).collect():
        own = part.where(F.col("leaf_agent") == r.leaf_agent)
        below = own.agg(
            F.count("*").alias("n"), F.max(r.metric).alias("max"), F.round(F.avg(r.metric), 2).alias("mean"),
            *(F.avg((F.col(r.metric) <= r[p]).cast("double")).alias(p) for p in ("p50", "p95")),
        ).first()
        assert (r.prompts, r.max, r.mean) == (below.n, below.max, below["mean"])
        assert abs(below.p50 - 0.5) < 0.02 and abs(below.p95 - 0.95) < 0.02


def test_a_day_that_is_loaded_again_replaces_its_own(spark, rows):
    path = scratch_path(spark, "actors")
    K.write_sketches(K.actor_sketches(rows), path)
    day = rows.where(F.to_date("event_timestamp") == "2026-01-02")
    K.write_sketches(K.actor_sketches(day.limit(100)), path)
    prompts = {str(r.event_date): r.n for r in spark.read.parquet(path).groupBy("event_date").agg(F.sum("prompts").alias("n")).collect()}
    assert prompts["2026-01-02"] == 100 and len(prompts) == 5 and sum(prompts.values()) == rows.count() - day.count() + 100


def test_no_rows(spark, rows):
    assert K.distinct_actors(K.actor_sketches(rows.limit(0))).count() == 0
    assert K.performance_of(K.performance_sketches(rows.limit(0))).count() == 0
