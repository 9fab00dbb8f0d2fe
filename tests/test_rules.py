"""Truth tables of the scoring, metric and judge rules."""

import itertools

from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions import metrics as M
from promptlens.functions import payload as P
from promptlens.functions import rubric as R
from promptlens.operators import judge as J
from promptlens.schema import curated_schema


def test_risk_over_all_subsets(spark):
    subsets = [
        list(c) for n in range(8) for c in itertools.combinations(sorted(V.INFO_TYPES), n)
    ]
    rows = spark.createDataFrame([(s,) for s in subsets], "t array<string>").select(
        "t", D.risk_level(F.col("t")).alias("risk"), D.is_toxic(F.col("t")).alias("toxic"),
        D.is_shadow(F.lit("Operations"), F.col("t")).alias("ops"), D.is_shadow(F.lit("HR"), F.col("t")).alias("hr"),
    ).collect()
    assert len(rows) == 128
    for r in rows:
        bank = V.ACCOUNT in r.t or V.ROUTING in r.t
        ssn, medical = V.SSN in r.t, V.MEDICAL in r.t
        toxic = ssn and (medical or bank)
        want = (
            "NONE" if not r.t else "CRITICAL" if toxic else "HIGH" if ssn or medical or bank
            else "MEDIUM" if V.DOB in r.t else "LOW"
        )
        assert (r.risk, r.toxic, r.ops, r.hr) == (want, toxic, ssn, False)


def test_metrics(spark):
    cases = [(lv, m) for lv in (*V.LEVELS, "other", None) for m in (5, 15, 45, 7)]
    rows = spark.createDataFrame(cases, "lv string, m long").withColumn(
        "x", M.maturity_multiplier(F.col("lv"))
    ).select("lv", "m", "x", M.adjusted_minutes(F.col("m"), F.col("x")).alias("a"),
             M.extra_minutes(F.col("m"), F.col("x")).alias("e"), M.level_index(F.col("lv")).alias("i"))
    for r in rows.collect():
        x = V.MATURITY_MULTIPLIERS.get(r.lv, 0.75)
        assert (r.x, r.a, r.e) == (x, round(r.m * x, 2), round(r.m * (1 - x), 2))
        assert r.i == (V.LEVELS.index(r.lv) + 1 if r.lv in V.LEVELS else None)


def test_improvement_and_gap(spark):
    cases = list(itertools.product(V.LEVELS, V.GROUNDINGS, (True, False), (True, False)))
    rows = spark.createDataFrame(cases, "lv string, g string, req boolean, pii boolean").withColumn(
        "gap", M.is_retrieval_gap(F.col("req"), F.col("g"))
    ).withColumn("need", R.needs_improvement(F.col("lv"), F.col("gap"), F.col("pii")))
    for r in rows.collect():
        gap = r.req and r.g == V.GROUNDING_NONE
        assert r.gap == gap
        assert r.need == (r.lv != V.LEVEL_3 or gap or r.pii)


def _judge(spark, text, connectors=(), leaf=V.NATIVE_CHAT_AGENT, types=(), department="HR"):
    df = spark.createDataFrame(
        [("1", department, V.CHAT, leaf, list(connectors), list(types), text)],
        "insert_id string, department string, interaction_type string, leaf_agent string, "
        "connectors_queried array<string>, dlp_info_types array<string>, prompt_text_masked string",
    )
    return J.rule_judge(df).first()


def test_judge_examples(spark):
    short = _judge(spark, "overtime policy rules")
    assert short.specification_maturity.level == V.LEVEL_1
    assert short.specification_maturity.is_search_query_style
    assert short.grounding_analysis.grounding_type == V.GROUNDING_NONE
    assert "enterprise_rag_connector" in short.prompt_coaching.missing_elements

    rich = _judge(
        spark, "Act as a payroll clerk and list the dates within May as a table", ["Workday_Payroll_Docs"]
    )
    assert rich.specification_maturity.level == V.LEVEL_3
    assert not rich.prompt_coaching.needs_improvement
    assert rich.prompt_coaching.improvement_recommendation == "No change needed."

    masked = _judge(spark, "Draft a letter for ***-**-1234 to close the matter", types=[V.SSN])
    assert masked.prompt_coaching.needs_improvement
    assert "***-**-" not in masked.prompt_coaching.rewritten_level_3_prompt
    assert masked.prompt_coaching.recommended_target_agent_or_connector.startswith("8_")

    code = _judge(spark, "Please debug the report script that fails every night", department="Finance")
    assert (code.functional_intent, code.task_complexity) == ("code_scripting", "high")
    assert code.estimated_manual_minutes == 45
    assert code.grounding_analysis.target_corpus == "codebase"

    for r in (short, rich, masked, code):
        target = r.prompt_coaching.recommended_target_agent_or_connector
        assert target in [a[1] for a in V.AGENTS] + [c for c in V.CONNECTORS if c != V.NOT_RECOMMENDED]


def test_word_limits(spark):
    texts = [" ".join(["w"] * n) for n in range(9)] + ["  a b   c ", "a\nb\tc d e", " " * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", R.is_short(F.col("t")).alias("short"), R.is_search_query_style(F.col("t")).alias("search"),
        P.word_count(F.col("t")).alias("n"),
    )
    for r in rows.collect():
        n = len(r.t.split())
        assert (r.n, r.short, r.search) == (n, n <= 5, 3 <= n <= 5)


def test_payload_conversions(spark):
    rows = spark.createDataFrame(
        [
            ('["a","b"]', "12", "projects/p/traces/t", "", "e1"),
            ("plain", " 7 ", "t", None, "e2"),
            (None, None, None, "i", "e3"),
            ("[broken", "x", "a/b/", "i", "e4"),
            ("[]", "1.5", "", "i", "e5"),
        ],
        "path string, n string, trace string, id string, event string",
    ).select(
        P.agent_path(F.col("path")).alias("path"), P.to_int(F.from_json(F.to_json(F.struct("n")), "n variant")["n"]).alias("n"),
        P.last_segment(F.col("trace")).alias("trace"),
        P.insert_id_or_event_id(F.col("id"), F.col("event")).alias("id"),
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("a -> b", 12, "t", "e1"), ("plain", 7, "t", "e2"), ("", 0, "", "i"),
        ("[broken", None, "", "i"), ("", None, "", "i"),
    ]


def test_event_time(spark):
    rows = spark.createDataFrame(
        [("2026-10-01T18:00:00.123Z",), ("2026-10-01T20:00:00.123+02:00",), ("soon",), (None,)], "t string"
    ).select(F.date_format(P.parse_event_time(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS").alias("t"))
    assert [r.t for r in rows.collect()] == ["2026-10-01 18:00:00.123"] * 2 + [None, None]


def test_mask_chars(spark):
    rows = spark.createDataFrame([("000-31-7742",), ("12",), ("",), ("a\nbcdef",)], "v string").select(
        D.mask_chars(F.col("v"), 5, skip="-").alias("a"), D.mask_chars(F.col("v"), 3, mask="$").alias("b")
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("***-**-7742", "$$$-31-7742"), ("**", "$$"), ("", ""), ("*****ef", "$$$cdef"),
    ]


def test_curated_schema():
    schema = curated_schema()
    assert len(schema) == 40
    assert all(f.metadata.get("comment") for f in schema.fields)
    assert [f.name for f in schema.fields if not f.nullable] == [
        "insert_id", "event_timestamp", "interaction_type", "anonymous_actor_hash"
    ]


def test_judgement_validation(spark):
    good = (
        '{"functional_intent":"code_scripting","task_complexity":"high","estimated_manual_minutes":40,'
        '"specification_maturity":{"level":"level_3_well_engineered","has_persona":true,"has_explicit_format":true,'
        '"has_constraints":true,"is_search_query_style":false},"grounding_analysis":{"grounding_type":"enterprise_rag",'
        '"requires_enterprise_knowledge":true,"target_corpus":"codebase"},"prompt_coaching":{"needs_improvement":false,'
        '"missing_elements":[],"improvement_recommendation":"","rewritten_level_3_prompt":"","recommended_target_agent_or_connector":"x"}}'
    )
    cases = {
        "good": good,
        "enum": good.replace('"codebase"', '"elsewhere"'),
        "element": good.replace('"missing_elements":[]', '"missing_elements":["tone"]'),
        "type": good.replace('"has_persona":true', '"has_persona":"yes"'),
        "absent": good.replace('"needs_improvement":false,', ""),
        "text": "sorry, no JSON",
        "empty": None,
    }
    df = spark.createDataFrame(list(cases.items()), "insert_id string, judge_json string")
    valid, bad = J.validate_judge(df)
    assert [r.insert_id for r in valid.collect()] == ["good"]
    assert {r.insert_id for r in bad.collect()} == set(cases) - {"good"}
