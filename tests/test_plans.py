"""What the physical plans must and must not contain."""

import hashlib

import pytest

from checks import base
from checks.telemetry_sql import INNER, OUTER, TEST_SEED
from promptlens.operators import curate as C
from promptlens.operators import judge as J
from promptlens.plans import reports as R

RAW = {"data", "entry", "prompt_text", "employee_name", "employee_email"}


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def nodes(df):
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        found.append(node)
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return found


def output(node):
    attributes = node.output().iterator()
    names = set()
    while attributes.hasNext():
        names.add(attributes.next().name())
    return names


def text(df):
    return df._jdf.queryExecution().toString()


def curated_frame(spark, sf):
    return C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark))


def test_nothing_raw_is_shuffled(spark, sf):
    found = nodes(C.cluster_for_write(curated_frame(spark, sf)))
    exchanges = [n for n in found if "Exchange" in n.nodeName()]
    assert len(exchanges) == 2  # duplicates by id, then rows by date
    for node in exchanges:
        assert not output(node) & RAW


def test_duplicates_are_dropped_before_the_shuffle(static, sf):
    plan = text(curated_frame(static, sf))
    assert "row_number(), 1, Partial" in plan and "row_number(), 1, Final" in plan


def test_the_key_is_not_in_the_plan(spark, sf):
    plan = text(curated_frame(spark, sf)).lower()
    key = hashlib.sha256(TEST_SEED.encode()).hexdigest()
    assert not any(secret in plan for secret in (INNER, OUTER, key, INNER[:32], OUTER[:32]))


def test_only_masked_columns_reach_the_judge(static, sf):
    df = J.judge_with(base.masked(static, sf), lambda: lambda batch: batch)
    found = [n for n in nodes(df) if n.nodeName() == "ArrowEvalPython"]
    assert len(found) == 1
    udf = found[0].udfs().head()
    references = udf.references().iterator()
    names = set()
    while references.hasNext():
        names.add(references.next().name())
    assert names and names <= set(J.JUDGE_INPUT)


def test_each_message_is_parsed_once(static, sf):
    plan = curated_frame(static, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructField(insertId") == 1


def test_reports_read_only_their_columns(spark, sf):
    found = nodes(R.workforce_maturity(base.curated(spark, sf)))
    scan = next(n for n in found if n.nodeName().startswith("Scan parquet")).requiredSchema().json()
    assert "level" in scan and "is_search_query_style" in scan
    assert "has_persona" not in scan and "prompt_text_masked" not in scan


def test_dates_are_pruned_and_filters_pushed(spark, sf):
    table = base.curated(spark, sf).where("event_date = '2024-01-05' AND interaction_type = 'x'")
    plan = text(table)
    assert "EqualTo(interaction_type,x)" in plan
    partitions = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "event_date" in partitions


def test_top_k_reports_do_not_sort_everything(static, sf):
    table = base.curated(static, sf)
    assert "TakeOrderedAndProject" in text(R.coaching_top(table))
    assert "row_number(), 5, Partial" in text(R.rewrites_by_unit(table))

