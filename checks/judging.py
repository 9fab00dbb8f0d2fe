"""Checked queries: judge facets, metrics and their audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import check, curated, joined, masked
from checks.telemetry_sql import sql
from promptlens import fixed_values as V
from promptlens.functions import metrics as M
from promptlens.functions import rubric as R
from promptlens.operators import audit as A
from promptlens.operators import enrich as E
from promptlens.operators import judge as J
from promptlens.plans import reports as Rep
from promptlens.session import prepare, scratch_path

TEXT, CONNECTORS, LEAF = "prompt_text_masked", "connectors_queried", "leaf_agent"
MINUTES, MULTIPLIER = "estimated_manual_minutes", "maturity_multiplier"


def _facet(name: str, expression: Callable[[], Column], column: str, sql_column: str | None = None) -> None:
    """A judge facet computed afresh from the masked columns."""

    @check(name, sql(f"SELECT insert_id, {sql_column or column} AS {column} FROM curated"))
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return curated(spark, sf).select("insert_id", expression().alias(column))


def _stored(name: str, columns: dict[str, str], sql_columns: list[str]) -> None:
    """A judge facet as the curated table holds it."""
    pairs = ", ".join(f"{s} AS {c}" for s, c in zip(sql_columns, columns))

    @check(name, sql(f"SELECT insert_id, {pairs} FROM curated"))
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return curated(spark, sf).select(
            "insert_id", *(F.col(path).alias(c) for c, path in columns.items())
        )


INPUT_SQL = (
    "SELECT insert_id, 'Department: ' || department || chr(10) || 'Interaction Mode: ' || interaction_type || chr(10)"
    " || 'Invoked Agent: ' || leaf_agent || chr(10) || 'Connectors Queried: ' || CASE WHEN len(connectors) > 0 THEN array_to_string(connectors, ', ') ELSE 'None' END || chr(10)"
    " || 'DLP InfoTypes Detected & Masked: ' || CASE WHEN len(info_types) > 0 THEN array_to_string(info_types, ', ') ELSE 'None' END || chr(10)"
    " || 'DLP-Masked Prompt Text:' || chr(10) || prompt_text_masked AS judge_input FROM masked"
)


@check("j1_render_judge_input", sql(INPUT_SQL, upto="masked"))
def judge_input(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select("insert_id", J.render_judge_input().alias("judge_input"))


def stub_factory():
    """A judge that answers from the text it is sent and errs on every tenth length.

    Nested, so that workers receive it by value and need no package installed.
    """

    def build():
        import json

        def answer(text: str) -> str:
            lines = text.split("\n")
            words = len(lines[-1].split())
            level = "level_1_underspecified" if words <= 5 else "level_2_basic_directive"
            return json.dumps(
                {
                    "functional_intent": "info_seeking_qa" if len(text) % 10 else "small_talk",
                    "task_complexity": "low",
                    "specification_maturity": {
                        "level": level, "has_persona": False, "has_explicit_format": False,
                        "has_constraints": False, "is_search_query_style": words <= 5,
                    },
                    "grounding_analysis": {
                        "grounding_type": "enterprise_rag", "requires_enterprise_knowledge": True,
                        "target_corpus": "unknown",
                    },
                    "estimated_manual_minutes": 5,
                    "prompt_coaching": {
                        "needs_improvement": True, "missing_elements": ["persona_role"],
                        "improvement_recommendation": "Name a role.",
                        "rewritten_level_3_prompt": "As an analyst, answer.",
                        "recommended_target_agent_or_connector": lines[2].split(": ", 1)[1],
                    },
                }
            )

        return lambda batch: [answer(t) for t in batch]

    return build


WORDS = "len(string_split(prompt_text_masked, ' '))"


@check(
    "j2_judge_with",
    sql(
        f"SELECT insert_id, CASE WHEN {WORDS} <= 5 THEN 'level_1_underspecified' ELSE 'level_2_basic_directive' END AS level,"
        f" leaf_agent AS recommended FROM ({INPUT_SQL.replace('SELECT insert_id,', 'SELECT *,')})",
        upto="masked",
    ),
)
def judged_outside(spark: SparkSession, sf: str) -> DataFrame:
    out = J.judge_with(masked(spark, sf), stub_factory())
    return out.select(
        "insert_id",
        F.get_json_object("judge_json", "$.specification_maturity.level").alias("level"),
        F.get_json_object("judge_json", "$.prompt_coaching.recommended_target_agent_or_connector").alias("recommended"),
    )


@check(
    "j3_validate_judge",
    sql(
        f"SELECT CASE WHEN length(judge_input) % 10 = 0 THEN 'invalid judgement' ELSE 'valid' END AS state, count(*) AS n"
        f" FROM ({INPUT_SQL}) GROUP BY 1",
        upto="masked",
    ),
)
def validated(spark: SparkSession, sf: str) -> DataFrame:
    judged = J.judge_with(masked(spark, sf), stub_factory())
    good, bad = J.validate_judge(J.store_judgements(judged, scratch_path(spark, "judged")))
    states = good.select(F.lit("valid").alias("state")).unionByName(bad.select(F.col("reason").alias("state")))
    return states.groupBy("state").agg(F.count("*").alias("n"))


check(
    "uf2_external_batch_function",
    sql(f"SELECT leaf_agent, count(*) AS n, sum(length(judge_input))::BIGINT AS characters FROM ({INPUT_SQL.replace('SELECT insert_id,', 'SELECT *,')}) GROUP BY 1", upto="masked"),
)(
    lambda spark, sf: J.judge_with(
        masked(spark, sf), lambda: lambda batch: [str(len(t)) for t in batch]
    ).groupBy("leaf_agent").agg(
        F.count("*").alias("n"), F.sum(F.col("judge_json").cast("bigint")).alias("characters")
    )
)

_facet("j4_functional_intent", lambda: R.functional_intent(R.first_verb(F.lower(F.col(TEXT)))), "functional_intent")
_facet("j5_task_complexity", lambda: R.task_complexity(F.col("functional_intent"), F.lower(F.col(TEXT)), F.col(CONNECTORS), R.is_search_query_style(F.col(TEXT))),
    "task_complexity",
)
_facet("j6_manual_minutes", lambda: M.manual_minutes(F.col("task_complexity")), "estimated_manual_minutes", "minutes::BIGINT")


@check("j7_maturity_flags", sql("SELECT insert_id, has_persona, has_explicit_format, has_constraints FROM curated"))
def maturity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return curated(spark, sf).select(
        "insert_id", R.has_persona(F.lower(F.col(TEXT))).alias("has_persona"),
        R.has_explicit_format(F.lower(F.col(TEXT))).alias("has_explicit_format"), R.has_constraints(F.lower(F.col(TEXT))).alias("has_constraints"),
    )


_facet("j8_search_query_style", lambda: R.is_search_query_style(F.col(TEXT)), "is_search_query_style")
_facet("j9_maturity_level", lambda: R.maturity_level(
        R.is_short(F.col(TEXT)), R.has_persona(F.lower(F.col(TEXT))), R.has_explicit_format(F.lower(F.col(TEXT))), R.has_constraints(F.lower(F.col(TEXT)))
    ),
    "level",
)
_facet("j10_grounding_type", lambda: R.grounding_type(F.lower(F.col(TEXT)), F.col(CONNECTORS), F.col(LEAF)), "grounding_type")
_facet("j11_requires_enterprise_knowledge", lambda: R.requires_enterprise_knowledge(F.lower(F.col(TEXT)), F.col(CONNECTORS)), "requires_enterprise_knowledge")
_facet("j12_target_corpus", lambda: R.target_corpus(F.col("functional_intent"), F.col(CONNECTORS), F.col(LEAF), F.col("department")), "target_corpus"
)


@check("j13_missing_elements", sql("SELECT insert_id, coalesce(array_to_string(missing_elements, ','), '') AS missing_elements FROM curated"))
def missing(spark: SparkSession, sf: str) -> DataFrame:
    return curated(spark, sf).select("insert_id", joined("prompt_coaching.missing_elements", "missing_elements"))


_stored("j14_needs_improvement", {"needs_improvement": "prompt_coaching.needs_improvement"}, ["needs_improvement"])
_stored("j15_improvement_recommendation", {"advice": "prompt_coaching.improvement_recommendation"}, ["recommendation"])
_stored("j16_rewritten_prompt", {"rewritten": "prompt_coaching.rewritten_level_3_prompt"}, ["rewritten"])
_stored(
    "j17_recommended_target", {"target": "prompt_coaching.recommended_target_agent_or_connector"}, ["recommended_target"]
)

PLAIN = "lower(text)"


@check(
    "j7_flags_on_conversations",
    "SELECT conv_id, turn, "
    f"regexp_matches({PLAIN}, '(^|[^a-z])(act as|you are an?|as a senior|in the role of)([^a-z]|$)') AS has_persona, "
    f"regexp_matches({PLAIN}, '(^|[^a-z])(markdown|table|json|bullets?|bullet points?|checklist|numbered list|yaml)([^a-z]|$)') AS has_explicit_format, "
    f"regexp_matches({PLAIN}, '(^|[^a-z])(limit|at most|at least|no more than|within|exclude|must not|do not|fewer than)([^a-z]|$)') AS has_constraints, "
    "len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) BETWEEN 3 AND 5 AS is_search_query_style "
    "FROM conversations WHERE role = 'user'",
)
def conversation_flags(spark: SparkSession, sf: str) -> DataFrame:
    turns = prepare(spark).read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    t = F.col("text")
    return turns.select(
        "conv_id", "turn", R.has_persona(F.lower(t)).alias("has_persona"),
        R.has_explicit_format(F.lower(t)).alias("has_explicit_format"),
        R.has_constraints(F.lower(t)).alias("has_constraints"),
        R.is_search_query_style(t).alias("is_search_query_style"),
    )


# ---- metrics -------------------------------------------------------------------

_facet("r1_maturity_multiplier", lambda: M.maturity_multiplier(F.col("specification_maturity.level")), "maturity_multiplier"
)
_facet("r2_adjusted_minutes_saved", lambda: M.adjusted_minutes(F.col(MINUTES), F.col(MULTIPLIER)), "adjusted_minutes_saved")
_facet("r3_potential_extra_minutes", lambda: M.extra_minutes(F.col(MINUTES), F.col(MULTIPLIER)), "potential_extra_minutes_unlocked"
)
_facet("r4_retrieval_gap", lambda: M.is_retrieval_gap(
        F.col("grounding_analysis.requires_enterprise_knowledge"), F.col("grounding_analysis.grounding_type")
    ),
    "is_retrieval_gap",
)


@check("r5_net_hours", sql("SELECT department, plant AS plant_location, round(sum(adj_q) / 4.0 / 60, 1)::DOUBLE AS net_hours FROM curated GROUP BY ALL"))
def net_hours(spark: SparkSession, sf: str) -> DataFrame:
    return Rep.unit_hours(curated(spark, sf), ["department", "plant_location"])


@check("r6_minutes_consistency_audit", sql("SELECT task_complexity, count(*) AS prompts, count(*) FILTER (shift = 'Shift 2' AND minutes <> 15) AS mismatches FROM curated GROUP BY 1"))
def minutes_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One shift reports 15 minutes whatever the task."""
    minutes = F.when(F.col("shift") == "Shift 2", 15).otherwise(F.col("estimated_manual_minutes")).cast("bigint")
    return A.minutes_consistency_audit(curated(spark, sf).withColumn("estimated_manual_minutes", minutes))


@check(
    "jn3_lookup_multiplier",
    sql("SELECT insert_id, CASE level WHEN 'level_1_underspecified' THEN 0.4 WHEN 'level_2_basic_directive' THEN 0.75 ELSE 1.0 END::DOUBLE AS maturity_multiplier FROM curated"),
)
def multiplier_table(spark: SparkSession, sf: str) -> DataFrame:
    """Configured multipliers; level 2 is left out and so gets the default."""
    configured = spark.createDataFrame([(V.LEVEL_1, 0.4), (V.LEVEL_3, 1.0)], "level string, maturity_multiplier double")
    rows = curated(spark, sf).select("insert_id", F.col("specification_maturity.level").alias("level"))
    return E.lookup_multiplier(rows, configured).select("insert_id", "maturity_multiplier")
