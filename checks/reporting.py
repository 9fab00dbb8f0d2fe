"""Checked queries: reports, filters, aggregations, joins, sorts and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.base import (
    DETECTORS, check, curated, delivered, disturbed, entries, events, flat, joined, stamp, test_key,
)
from checks.telemetry_sql import sql
from promptlens import fixed_values as V
from promptlens.functions import metrics as M
from promptlens.operators import curate as C
from promptlens.operators import enrich as E
from promptlens.operators import trigrams as G
from promptlens.plans import reports as R
from promptlens.plans import sketches as K
from promptlens.session import scratch_path
from promptlens.sources import dimensions as Dim
from promptlens.sources import logs as L
from checks import telemetry as T


def mean2(total: str, count: str, scale: int) -> str:
    """Mean of total/scale over count, rounded half up to two decimals in whole numbers."""
    d = 2 * scale * 1
    return f"(((200 * ({total}) + {scale} * ({count})) // ({d} * ({count}))) / 100.0)::DOUBLE"


def pct(part: str) -> str:
    return f"round(count(*) FILTER ({part}) / count(*) * 100, 1)::DOUBLE"


LEVEL_NO = "CASE level WHEN 'level_1_underspecified' THEN 1 WHEN 'level_2_basic_directive' THEN 2 ELSE 3 END"
MATURITY = (
    "SELECT department AS business_unit, count(*) AS total_prompts, count(DISTINCT anonymous_actor_hash) AS unique_employees, "
    f"{mean2(f'sum({LEVEL_NO})', 'count(*)', 1)} AS workforce_maturity_index_1_to_3, "
    + ", ".join(f"{pct(f'level = {chr(39)}{name}{chr(39)}')} AS {name}_pct" for name in ("level_1_underspecified", "level_2_basic_directive", "level_3_well_engineered"))
    + f", {pct('is_search_query_style')} AS search_query_habit_pct FROM curated GROUP BY 1"
)
EXPOSURE = (
    "count(*) AS total_prompts, count(*) FILTER (len(info_types) > 0) AS dlp_flagged_prompts, count(*) FILTER (f_ssn) AS ssn_prompts, "
    f"count(*) FILTER (is_toxic_combination) AS toxic_combination_prompts, {pct('f_ssn')} AS ssn_leak_rate_pct"
)
HOURS = "round(sum({}) / 4.0 / 60, 1)::DOUBLE"


def _report(name: str, report, oracle: str) -> None:
    @check(name, oracle)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return report(curated(spark, sf))


def _flat_coaching(df: DataFrame) -> DataFrame:
    return df.withColumn("missing_elements", F.array_join("missing_elements", ","))


COACHING_SQL = (
    "insert_id, department AS business_unit, level AS current_maturity_level, is_retrieval_gap, prompt_text_masked AS original_masked_prompt,"
    " coalesce(array_to_string(missing_elements, ','), '') AS missing_elements, recommendation AS improvement_recommendation, rewritten AS rewritten_level_3_prompt,"
    " recommended_target AS recommended_target_agent_or_connector, potential_extra_minutes_unlocked"
)
COACHING_ORDER = "potential_extra_minutes_unlocked DESC, is_retrieval_gap DESC, insert_id"

_report("q1_workforce_maturity", R.workforce_maturity, sql(MATURITY))
_report(
    "q2_retrieval_gaps", R.retrieval_gaps,
    sql(
        "SELECT department AS business_unit, target_corpus AS target_knowledge_corpus, count(*) AS total_prompts,"
        " count(*) FILTER (grounding_type = 'enterprise_rag') AS enterprise_rag_prompts,"
        " count(*) FILTER (grounding_type = 'in_context_attachment') AS pasted_in_context_prompts,"
        f" count(*) FILTER (is_retrieval_gap) AS retrieval_gap_prompts, {pct('is_retrieval_gap')} AS retrieval_gap_rate_pct FROM curated GROUP BY 1, 2"
    ),
)
_report(
    "q3_business_unit_roi", R.business_unit_roi,
    sql(
        "SELECT department AS business_unit, functional_intent, count(*) AS prompt_count, round(sum(minutes) / 60.0, 1)::DOUBLE AS raw_manual_hours_baseline,"
        f" {mean2('sum(quarters)', 'count(*)', 4)} AS avg_maturity_multiplier, {HOURS.format('adj_q')} AS net_adjusted_hours_saved,"
        f" {HOURS.format('extra_q')} AS extra_hours_unlocked_by_level_3_coaching FROM curated GROUP BY 1, 2"
    ),
)
_report(
    "q4_governance_exposure", R.governance_exposure,
    sql(f"SELECT interaction_type, pillar, leaf_agent, {EXPOSURE} FROM curated GROUP BY 1, 2, 3"),
)
_report(
    "q5_incident_story", R.incident_story,
    sql(
        "SELECT interaction_type, pillar, leaf_agent, topic AS topic_cluster, functional_intent, count(*) AS prompt_volume,"
        f" count(*) FILTER (f_ssn AND f_med) AS ssn_plus_injury_phi_claims, {HOURS.format('adj_q')} AS hours_saved_on_incident,"
        " arg_min(prompt_text_masked, insert_id) AS sample_masked_prompt FROM curated"
        " WHERE entity LIKE '%Line 3%' OR entity LIKE '%Lot #402%' GROUP BY 1, 2, 3, 4, 5"
    ),
)
_report(
    "q6_coaching_top", lambda c: _flat_coaching(R.coaching_top(c)),
    sql(f"SELECT {COACHING_SQL} FROM curated WHERE needs_improvement ORDER BY {COACHING_ORDER} LIMIT 20"),
)
_report(
    "q7_connector_exposure", R.connector_exposure,
    sql(f"SELECT connector, {EXPOSURE} FROM (SELECT *, unnest(connectors) AS connector FROM curated) GROUP BY 1"),
)
_report(
    "q8_missing_element_counts", R.missing_element_counts,
    sql(
        "SELECT department AS business_unit, m AS missing_element, count(*) AS prompts FROM"
        " (SELECT department, unnest(missing_elements) AS m FROM curated) GROUP BY 1, 2"
    ),
)
_report(
    "q9_training_priority", R.training_priority,
    sql(f"SELECT * FROM ({MATURITY}) ORDER BY workforce_maturity_index_1_to_3, search_query_habit_pct DESC, business_unit LIMIT 1"),
)
_report(
    "q10_gap_without_connector", R.gap_without_connector,
    sql(
        "SELECT department AS business_unit, target_corpus AS target_knowledge_corpus, count(*) AS gap_prompts FROM curated"
        " WHERE is_retrieval_gap AND len(connectors) = 0 GROUP BY 1, 2"
    ),
)
_report(
    "q11_fault_to_claim_correlation", R.fault_to_claim_correlation,
    sql(
        "SELECT line, sum(ops)::BIGINT AS operations_prompts, sum(fin)::BIGINT AS finance_prompts, sum(hr)::BIGINT AS hr_prompts,"
        " sum(f)::BIGINT AS fault_prompts, sum(c)::BIGINT AS injury_claims, count(*) FILTER (f > 0 AND c > 0) AS shared_days FROM ("
        " SELECT regexp_extract(entity, 'Line [0-9]+') AS line, event_timestamp::DATE AS day, count(*) FILTER (pillar = 'Operations') AS ops,"
        " count(*) FILTER (pillar = 'Finance') AS fin, count(*) FILTER (pillar = 'HR') AS hr,"
        " count(*) FILTER (entity LIKE '%ERR-PLC-409%' AND pillar = 'Operations') AS f, count(*) FILTER (f_ssn AND f_med) AS c"
        " FROM curated GROUP BY 1, 2) WHERE line <> '' GROUP BY 1"
    ),
)
_report(
    "q12_risk_distribution", R.risk_distribution,
    sql("SELECT dlp_risk_level, count(*) AS prompts FROM curated GROUP BY 1"),
)
_report(
    "q13_shadow_prompts", R.shadow_prompts,
    sql(
        "SELECT plant AS plant_location, shift, leaf_agent, count(*) AS total_prompts, count(*) FILTER (is_shadow_prompt) AS shadow_prompts"
        " FROM curated GROUP BY 1, 2, 3 HAVING count(*) FILTER (is_shadow_prompt) > 0"
    ),
)
_report(
    "q14_roi_total", R.roi_total,
    sql(
        f"SELECT coalesce(department, 'ALL UNITS') AS business_unit, count(*) AS prompt_count, {HOURS.format('adj_q')} AS net_adjusted_hours_saved,"
        f" {HOURS.format('extra_q')} AS extra_hours_unlocked FROM curated GROUP BY ROLLUP (department)"
    ),
)
_report(
    "q15_dominant_intent", R.dominant_intent,
    sql(
        "SELECT interaction_type, functional_intent, count(*) AS prompts FROM curated GROUP BY 1, 2"
        " QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY count(*) DESC, functional_intent) = 1"
    ),
)
_report(
    "q16_actor_activity", lambda c: R.actor_activity(c).withColumn("day", F.col("day").cast("string")),
    sql(
        "SELECT anonymous_actor_hash, strftime(event_timestamp, '%Y-%m-%d') AS day, count(*) AS prompts,"
        f" {mean2(f'sum({LEVEL_NO})', 'count(*)', 1)} AS mean_level,"
        " sum(count(*)) OVER (PARTITION BY anonymous_actor_hash ORDER BY strftime(event_timestamp, '%Y-%m-%d'))::BIGINT AS running_prompts"
        " FROM curated GROUP BY 1, 2"
    ),
)
_report(
    "q17_performance_summary", R.performance_summary,
    sql(
        " UNION ALL ".join(
            f"SELECT interaction_type, leaf_agent, '{m}' AS metric, count(*) AS prompts, {mean2(f'sum({m})', 'count(*)', 1)} AS mean,"
            f" round(quantile_cont({m}, 0.5), 2)::DOUBLE AS p50, round(quantile_cont({m}, 0.95), 2)::DOUBLE AS p95, max({m})::BIGINT AS max FROM curated GROUP BY 1, 2"
            for m in ("latency_ms", "prompt_tokens", "response_tokens")
        )
    ),
)
_report(
    "q18_delegation_edges", R.delegation_edges,
    sql(
        "SELECT caller, callee, count(*) AS calls FROM ("
        " SELECT 'CME_Enterprise_Router' AS caller, lead_agent AS callee FROM curated WHERE NOT chat"
        " UNION ALL SELECT lead_agent, agent FROM curated WHERE NOT chat AND lead_agent <> agent) GROUP BY 1, 2"
    ),
)
_report(
    "q19_recommended_vs_actual", R.recommended_vs_actual,
    sql(
        "SELECT recommended_target AS recommended, count(*) AS prompts, count(*) FILTER (leaf_agent = recommended_target OR list_contains(connectors, recommended_target)) AS already_used,"
        f" {pct('leaf_agent = recommended_target OR list_contains(connectors, recommended_target)')} AS already_used_pct FROM curated GROUP BY 1"
    ),
)
_report(
    "q20_rewrites_by_unit", lambda c: _flat_coaching(R.rewrites_by_unit(c)),
    sql(
        f"SELECT row_number() OVER (PARTITION BY department ORDER BY {COACHING_ORDER})::INT AS rank, {COACHING_SQL} FROM curated WHERE needs_improvement"
        f" QUALIFY row_number() OVER (PARTITION BY department ORDER BY {COACHING_ORDER}) <= 5"
    ),
)
_report(
    "q21_search_habit_by_actor", R.search_habit_by_actor,
    sql(
        "SELECT anonymous_actor_hash, count(*) AS total_prompts, count(*) FILTER (is_search_query_style) AS search_style_prompts,"
        f" {pct('is_search_query_style')} AS search_habit_pct FROM curated GROUP BY 1"
    ),
)

# ---- filters -------------------------------------------------------------------

_report(
    "f1_equality_in_count",
    lambda c: c.groupBy("department").agg(
        *(F.count_if(F.col("specification_maturity.level") == v).alias(f"n{i}") for i, v in enumerate(V.LEVELS, 1)),
        *(F.count_if(F.col("grounding_analysis.grounding_type") == v).alias(f"g{i}") for i, v in enumerate(V.GROUNDINGS, 1)),
    ),
    sql(
        "SELECT department, " + ", ".join(f"count(*) FILTER (level = '{v}') AS n{i}" for i, v in enumerate(("level_1_underspecified", "level_2_basic_directive", "level_3_well_engineered"), 1)) + ", "
        + ", ".join(f"count(*) FILTER (grounding_type = '{v}') AS g{i}" for i, v in enumerate(("enterprise_rag", "in_context_attachment", "parametric_general"), 1)) + " FROM curated GROUP BY 1"
    ),
)
_report(
    "f2_boolean_predicate",
    lambda c: c.groupBy("shift").agg(
        # a null flag counts as not matched
        F.count_if(F.when(F.col("pillar") != "HR", F.col("contains_ssn"))).alias("outside_hr"),
        F.count_if("dlp_detected").alias("flagged"),
    ),
    sql("SELECT shift, count(*) FILTER (f_ssn AND pillar <> 'HR') AS outside_hr, count(*) FILTER (len(info_types) > 0) AS flagged FROM curated GROUP BY 1"),
)
_report(
    "f3_conjunction_in_count",
    lambda c: c.groupBy("pillar").agg(F.count_if(F.col("contains_ssn") & F.col("contains_medical_phi")).alias("claims")),
    sql("SELECT pillar, count(*) FILTER (f_ssn AND f_med) AS claims FROM curated GROUP BY 1"),
)
_report(
    "f4_substring_filter",
    lambda c: c.where(R.mentions(F.col("operational_entity"), V.INCIDENT_TERMS)).select("insert_id", "operational_entity"),
    sql("SELECT insert_id, entity AS operational_entity FROM curated WHERE entity LIKE '%Line 3%' OR entity LIKE '%Lot #402%'"),
)
_report(
    "f5_struct_field_filter",
    lambda c: c.where(F.col("prompt_coaching.needs_improvement")).select("insert_id"),
    sql("SELECT insert_id FROM curated WHERE needs_improvement"),
)


@check("f6_route_disjunction", sql("SELECT department, count(*) AS n FROM flat WHERE chat GROUP BY 1", upto="flat"))
def one_stream(spark: SparkSession, sf: str) -> DataFrame:
    named = entries(spark, sf).withColumn("log_name", F.col("entry.logName"))
    return L.route_logs(named, (V.CHAT_STREAM, "another-stream")).groupBy(
        F.col("entry.jsonPayload.department").alias("department")
    ).agg(F.count("*").alias("n"))


# ---- aggregations --------------------------------------------------------------

_report("a1_count", lambda c: c.agg(F.count("*").alias("n")), sql("SELECT count(*) AS n FROM curated"))
_report(
    "a2_count_distinct",
    lambda c: c.groupBy("department", "plant_location").agg(F.countDistinct("anonymous_actor_hash").alias("actors")),
    sql("SELECT department, plant AS plant_location, count(DISTINCT anonymous_actor_hash) AS actors FROM curated GROUP BY ALL"),
)
_report(
    "a3_count_if",
    lambda c: c.groupBy("plant_location").agg(F.count_if("is_retrieval_gap").alias("gaps"), F.count_if("is_shadow_prompt").alias("shadow")),
    sql("SELECT plant AS plant_location, count(*) FILTER (is_retrieval_gap) AS gaps, count(*) FILTER (is_shadow_prompt) AS shadow FROM curated GROUP BY 1"),
)
_report(
    "a4_avg_case_without_else",
    lambda c: c.groupBy("pillar").agg(
        F.round(F.avg(F.when(F.col("task_complexity") != "high", M.level_index(F.col("specification_maturity.level")))), 2).alias("mean_level")
    ),
    sql(f"SELECT pillar, {mean2(f'sum({LEVEL_NO})', 'count(*)', 1)} AS mean_level FROM curated WHERE task_complexity <> 'high' GROUP BY 1"),
)
_report(
    "a5_avg",
    lambda c: c.groupBy("leaf_agent").agg(F.round(F.avg("maturity_multiplier"), 2).alias("mean_multiplier")),
    sql(f"SELECT leaf_agent, {mean2('sum(quarters)', 'count(*)', 4)} AS mean_multiplier FROM curated GROUP BY 1"),
)
_report(
    "a6_sum_to_hours",
    lambda c: c.groupBy("functional_intent").agg(M.hours(F.col("estimated_manual_minutes")).alias("hours")),
    sql("SELECT functional_intent, round(sum(minutes) / 60.0, 1)::DOUBLE AS hours FROM curated GROUP BY 1"),
)
_report(
    "a7_any_value",
    lambda c: c.groupBy("topic_cluster", "pillar").agg(
        F.min_by("prompt_text_masked", "insert_id").alias("sample"),
        F.any_value("pillar").alias("any_pillar"),
    ),
    sql("SELECT topic AS topic_cluster, pillar, arg_min(prompt_text_masked, insert_id) AS sample, pillar AS any_pillar FROM curated GROUP BY 1, 2"),
)
_report(
    "a8_safe_divide_rate",
    lambda c: c.groupBy("leaf_agent").agg(
        M.pct(F.count_if("contains_ssn"), F.count_if("dlp_detected")).alias("ssn_share_of_flagged_pct")
    ),
    sql(
        "SELECT leaf_agent, round(count(*) FILTER (f_ssn) / nullif(count(*) FILTER (len(info_types) > 0), 0) * 100, 1)::DOUBLE AS ssn_share_of_flagged_pct FROM curated GROUP BY 1"
    ),
)
_report(
    "a9_group_by_five_keys",
    lambda c: c.groupBy(
        F.col("department").alias("unit"), "shift", "interaction_type",
        F.col("specification_maturity.level").alias("level"),
        F.col("grounding_analysis.target_corpus").alias("corpus"),
    ).agg(F.count("*").alias("n")),
    sql("SELECT department AS unit, shift, interaction_type, level, target_corpus AS corpus, count(*) AS n FROM curated GROUP BY ALL"),
)
_report(
    "a10_distinct_sets",
    lambda c: c.select("department", F.explode("dlp_info_types").alias("t")).distinct()
    .groupBy("department").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("info_types")),
    sql(
        "SELECT department, string_agg(t, ',' ORDER BY t) AS info_types FROM (SELECT DISTINCT department, unnest(info_types) AS t FROM curated) GROUP BY 1"
    ),
)
_report(
    "a12_rollup",
    lambda c: c.rollup("department", "plant_location").agg(F.count("*").alias("n")).select(
        F.coalesce("department", F.lit("*")).alias("department"),
        F.coalesce("plant_location", F.lit("*")).alias("plant_location"), "n",
    ),
    sql("SELECT coalesce(department, '*') AS department, coalesce(plant, '*') AS plant_location, count(*) AS n FROM curated GROUP BY ROLLUP (department, plant)"),
)

# ---- joins ---------------------------------------------------------------------


@check(
    "jn1_enrich_agent",
    sql("SELECT insert_id, agent_num, agent AS id, CASE WHEN agent_num <= 4 THEN 'Operations' WHEN agent_num <= 7 THEN 'Finance' ELSE 'HR' END AS pillar FROM flat", upto="flat"),
)
def enrich_agent(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.facts(events(spark, sf)).select(
        F.concat(F.lit("log-"), F.col("event_id").cast("string")).alias("insert_id"), "agent_num"
    )
    return E.enrich_agent(rows, Dim.agent_catalog(spark)).select("insert_id", "agent_num", "id", "pillar")


@check(
    "jn2_enrich_employee",
    sql("SELECT insert_id, 'usr_' || left(hmac_hex, 8) AS anonymous_actor_hash, department, role AS employee_role, plant AS plant_location, shift FROM masked", upto="masked"),
)
def enrich_employee(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf).select(
        F.col("entry.insertId").alias("insert_id"), F.col("entry.jsonPayload.employee_id").alias("employee_id")
    )
    return E.enrich_employee(rows, T.roster(events(spark, sf)), test_key(spark)).select(
        "insert_id", "anonymous_actor_hash", "department", "employee_role", "plant_location", "shift"
    )


@check(
    "jn4_orphan_agents",
    sql("SELECT leaf_agent, count(*) AS prompts FROM curated WHERE NOT chat AND agent_num IN (2, 9) GROUP BY 1"),
)
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Against a catalog that lost two agents."""
    catalog = Dim.agent_catalog(spark).where(~F.col("agent_num").isin(2, 9))
    return E.orphan_agents(curated(spark, sf), catalog)


@check("jn5_already_loaded", sql("SELECT insert_id FROM curated WHERE pillar <> 'Finance'"))
def already_loaded(spark: SparkSession, sf: str) -> DataFrame:
    table = curated(spark, sf)
    return E.already_loaded(table, table.where("pillar = 'Finance'")).select("insert_id")


@check(
    "jn6_co_occurrence",
    sql(
        "SELECT strftime(a.day, '%Y-%m-%d') AS day, a.line, a.n AS faults, b.n AS claims FROM"
        " (SELECT event_timestamp::DATE AS day, regexp_extract(entity, 'Line [0-9]') AS line, count(*) AS n FROM curated WHERE entity LIKE '%ERR-PLC-409%' AND pillar = 'Operations' GROUP BY 1, 2) a"
        " JOIN (SELECT event_timestamp::DATE AS day, regexp_extract(entity, 'Line [0-9]') AS line, count(*) AS n FROM curated WHERE f_ssn AND f_med GROUP BY 1, 2) b USING (day, line)"
    ),
)
def co_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    table = curated(spark, sf).select(
        F.date_format("event_timestamp", "yyyy-MM-dd").alias("day"),
        F.regexp_extract("operational_entity", "Line [0-9]+", 0).alias("line"),
        "operational_entity", "pillar", "contains_ssn", "contains_medical_phi",
    )
    faults = table.where(F.col("operational_entity").contains("ERR-PLC-409") & (F.col("pillar") == "Operations"))
    claims = table.where(F.col("contains_ssn") & F.col("contains_medical_phi"))
    return faults.groupBy("day", "line").agg(F.count("*").alias("faults")).join(
        claims.groupBy("day", "line").agg(F.count("*").alias("claims")), ["day", "line"]
    )


# ---- sorts, windows, unions ----------------------------------------------------


def _positions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Position of each row of a small sorted report, so that the order is compared too."""
    w = Window.orderBy(F.monotonically_increasing_id())
    return df.select(F.row_number().over(w).alias("position"), *columns)


_report(
    "o1_single_key_ascending",
    lambda c: _positions(R.workforce_maturity(c), ["business_unit"]),
    sql(f"SELECT row_number() OVER (ORDER BY workforce_maturity_index_1_to_3, business_unit)::INT AS position, business_unit FROM ({MATURITY})"),
)
_report(
    "o2_multi_key_descending",
    lambda c: _positions(R.governance_exposure(c), ["interaction_type", "pillar", "leaf_agent"]),
    sql(
        "SELECT row_number() OVER (ORDER BY s DESC, n DESC, interaction_type, pillar, leaf_agent)::INT AS position, interaction_type, pillar, leaf_agent FROM"
        " (SELECT interaction_type, pillar, leaf_agent, count(*) FILTER (f_ssn) AS s, count(*) AS n FROM curated GROUP BY 1, 2, 3)"
    ),
)
_report(
    "o3_mixed_directions",
    lambda c: _positions(R.business_unit_roi(c), ["business_unit", "functional_intent"]),
    sql(
        "SELECT row_number() OVER (ORDER BY business_unit, h DESC, functional_intent)::INT AS position, business_unit, functional_intent FROM"
        f" (SELECT department AS business_unit, functional_intent, {HOURS.format('adj_q')} AS h FROM curated GROUP BY 1, 2)"
    ),
)
_report(
    "o4_boolean_sort_key",
    lambda c: _positions(
        c.groupBy("is_retrieval_gap", "department").agg(F.count("*").alias("n")).orderBy(F.desc("is_retrieval_gap"), "department"),
        ["is_retrieval_gap", "department", "n"],
    ),
    sql(
        "SELECT row_number() OVER (ORDER BY is_retrieval_gap DESC, department)::INT AS position, is_retrieval_gap, department, count(*) AS n FROM curated GROUP BY is_retrieval_gap, department"
    ),
)
_report(
    "o5_top_k",
    lambda c: c.orderBy(F.desc("latency_ms"), "insert_id").limit(50).select("insert_id", "latency_ms"),
    sql("SELECT insert_id, latency_ms FROM curated ORDER BY latency_ms DESC, insert_id LIMIT 50"),
)
_report(
    "o6_sorted_arrays",
    lambda c: c.select("insert_id", joined(F.array_sort("connectors_queried"), "connectors"), joined("dlp_info_types", "info_types")),
    sql(
        "SELECT insert_id, coalesce(array_to_string(list_sort(connectors), ','), '') AS connectors, coalesce(array_to_string(list_sort(info_types), ','), '') AS info_types FROM curated"
    ),
)
_report(
    "o7_event_time_order",
    lambda c: c.groupBy("anonymous_actor_hash").agg(
        F.min_by("insert_id", F.struct("event_timestamp", "insert_id")).alias("first_id"),
        F.max_by("insert_id", F.struct("event_timestamp", "insert_id")).alias("last_id"),
    ),
    sql(
        "SELECT anonymous_actor_hash, arg_min(insert_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%g') || insert_id) AS first_id,"
        " arg_max(insert_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%g') || insert_id) AS last_id FROM curated GROUP BY 1"
    ),
)
_report(
    "w1_window_functions",
    lambda c: c.groupBy("leaf_agent", F.date_format("event_timestamp", "yyyy-MM-dd").alias("day"))
    .agg(F.count("*").alias("n"))
    .withColumn("previous", F.lag("n").over(Window.partitionBy("leaf_agent").orderBy("day")))
    .withColumn("rank", F.rank().over(Window.partitionBy("leaf_agent").orderBy(F.desc("n")))),
    sql(
        "SELECT leaf_agent, strftime(event_timestamp, '%Y-%m-%d') AS day, count(*) AS n,"
        " lag(count(*)) OVER (PARTITION BY leaf_agent ORDER BY strftime(event_timestamp, '%Y-%m-%d')) AS previous,"
        " (rank() OVER (PARTITION BY leaf_agent ORDER BY count(*) DESC))::INT AS rank FROM curated GROUP BY 1, 2"
    ),
)


@check(
    "u1_union_of_streams",
    sql("SELECT insert_id, CASE WHEN NOT chat THEN leaf_agent END AS leaf_agent, CASE WHEN chat THEN 'bottler-search' END AS ge_app_id FROM flat", upto="flat"),
)
def union(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows lack the agent fields, agent rows the chat fields."""
    e = entries(spark, sf).select("entry.*")
    p = F.col("jsonPayload")
    chat = e.where(p["interaction_type"] == V.CHAT).select(
        F.col("insertId").alias("insert_id"), p["ge_app_id"].alias("ge_app_id")
    )
    agent = e.where(p["interaction_type"] == V.AGENT).select(
        F.col("insertId").alias("insert_id"), p["leaf_agent"].alias("leaf_agent")
    )
    return L.union_streams(chat, agent).select("insert_id", "leaf_agent", "ge_app_id")


# ---- sketches of days ------------------------------------------------------------

@check("a2_actors_of_a_span", sql("SELECT department AS unit, count(*) AS prompts, TRUE AS close FROM curated WHERE event_timestamp >= TIMESTAMP '2024-01-10' GROUP BY 1"))
def actors_of_a_span(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct actors over the stored sketches of some days, within three per cent of the exact count."""
    path = scratch_path(spark, "actor-sketches")
    K.write_sketches(K.actor_sketches(curated(spark, sf)), path)
    about = K.distinct_actors(spark.read.parquet(path).where("event_date >= '2024-01-10'"))
    exact = curated(spark, sf).where("event_date >= '2024-01-10'").groupBy(F.col("department").alias("unit")).agg(F.countDistinct("anonymous_actor_hash").alias("exact"))
    return about.join(exact, "unit").select("unit", "prompts", (F.abs(F.col("actors") - F.col("exact")) <= 0.03 * F.col("exact")).alias("close"))


@check(
    "q17_performance_of_a_span",
    sql(
        " UNION ALL ".join(
            f"SELECT interaction_type, leaf_agent, '{m}' AS metric, count(*) AS prompts, {mean2(f'sum({m})', 'count(*)', 1)} AS mean, max({m})::BIGINT AS max, TRUE AS close"
            " FROM curated WHERE event_timestamp >= TIMESTAMP '2024-01-10' GROUP BY 1, 2"
            for m in ("latency_ms", "prompt_tokens", "response_tokens")
        )
    ),
)
def performance_of_a_span(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles over the stored sketches of some days; their ranks are within two per cent of what was asked."""
    path = scratch_path(spark, "performance-sketches")
    K.write_sketches(K.performance_sketches(curated(spark, sf)), path)
    about = K.performance_of(spark.read.parquet(path).where("event_date >= '2024-01-10'"))
    rows = curated(spark, sf).where("event_date >= '2024-01-10'").select("interaction_type", "leaf_agent", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in R.PERFORMANCE))))
    keys = ["interaction_type", "leaf_agent", "metric"]
    # a value holds all ranks from those below it to those up to it
    ranks = rows.join(about, keys).groupBy(*keys).agg(*(F.avg((F.col("v") < F.col(p)).cast("double")).alias(f"{p}_low") for p in ("p50", "p95")), *(F.avg((F.col("v") <= F.col(p)).cast("double")).alias(f"{p}_high") for p in ("p50", "p95")))
    close = (F.col("p50_low") <= 0.52) & (F.col("p50_high") >= 0.48) & (F.col("p95_low") <= 0.97) & (F.col("p95_high") >= 0.93)
    return about.join(ranks, keys).select(*keys, "prompts", "mean", "max", close.alias("close"))


@check("f4_substring_in_few_files", sql("SELECT insert_id, entity AS operational_entity FROM curated WHERE entity LIKE '%Line 3%' OR entity LIKE '%Lot #402%'"))
def substring_in_few_files(spark: SparkSession, sf: str) -> DataFrame:
    """The substring filter over a table whose files have trigram filters."""
    path = scratch_path(spark, "indexed")
    C.write_curated(curated(spark, sf).drop("event_date"), path)
    G.index_files(spark, path)
    return G.holding(spark, path, V.INCIDENT_TERMS).select("insert_id", "operational_entity")
