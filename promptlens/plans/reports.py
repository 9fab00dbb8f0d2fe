"""Reports over the curated table. Each takes the table and returns a DataFrame.

All grouping is two-phase (partial before the shuffle), so a unit that holds a large
share of the rows costs one partial row per task and group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions import metrics as M
from promptlens.functions import payload as P

LEVEL = "specification_maturity.level"
SEARCH = "specification_maturity.is_search_query_style"


def _exposure() -> list[Column]:
    return [
        F.count("*").alias("total_prompts"),
        F.count_if("dlp_detected").alias("dlp_flagged_prompts"),
        F.count_if("contains_ssn").alias("ssn_prompts"),
        F.count_if("is_toxic_combination").alias("toxic_combination_prompts"),
        M.pct(F.count_if("contains_ssn"), F.count("*")).alias("ssn_leak_rate_pct"),
    ]


def workforce_maturity(curated: DataFrame) -> DataFrame:
    """Maturity index, level shares and search habit per business unit."""
    level, n = F.col(LEVEL), F.count("*")
    return (
        curated.groupBy(F.col("department").alias("business_unit"))
        .agg(
            n.alias("total_prompts"),
            F.countDistinct("anonymous_actor_hash").alias("unique_employees"),
            F.round(F.avg(M.level_index(level)), 2).alias("workforce_maturity_index_1_to_3"),
            *(M.pct(F.count_if(level == name), n).alias(f"{name}_pct") for name in V.LEVELS),
            M.pct(F.count_if(SEARCH), n).alias("search_query_habit_pct"),
        )
        .orderBy("workforce_maturity_index_1_to_3", "business_unit")
    )


def retrieval_gaps(curated: DataFrame) -> DataFrame:
    """Grounding and retrieval gaps per business unit and knowledge domain."""
    kind, n = F.col("grounding_analysis.grounding_type"), F.count("*")
    return (
        curated.groupBy(
            F.col("department").alias("business_unit"),
            F.col("grounding_analysis.target_corpus").alias("target_knowledge_corpus"),
        )
        .agg(
            n.alias("total_prompts"),
            F.count_if(kind == V.GROUNDING_RAG).alias("enterprise_rag_prompts"),
            F.count_if(kind == V.GROUNDING_PASTED).alias("pasted_in_context_prompts"),
            F.count_if("is_retrieval_gap").alias("retrieval_gap_prompts"),
            M.pct(F.count_if("is_retrieval_gap"), n).alias("retrieval_gap_rate_pct"),
        )
        .orderBy(
            F.desc("retrieval_gap_prompts"), F.desc("total_prompts"),
            "business_unit", "target_knowledge_corpus",
        )
    )


def business_unit_roi(curated: DataFrame) -> DataFrame:
    """Hours saved and hours left on the table per business unit and intent."""
    return (
        curated.groupBy(F.col("department").alias("business_unit"), "functional_intent")
        .agg(
            F.count("*").alias("prompt_count"),
            M.hours(F.col("estimated_manual_minutes")).alias("raw_manual_hours_baseline"),
            F.round(F.avg("maturity_multiplier"), 2).alias("avg_maturity_multiplier"),
            M.hours(F.col("adjusted_minutes_saved")).alias("net_adjusted_hours_saved"),
            M.hours(F.col("potential_extra_minutes_unlocked")).alias(
                "extra_hours_unlocked_by_level_3_coaching"
            ),
        )
        .orderBy("business_unit", F.desc("net_adjusted_hours_saved"), "functional_intent")
    )


def governance_exposure(curated: DataFrame) -> DataFrame:
    """Sensitive data and toxic combinations per interaction type, pillar and agent."""
    keys = ["interaction_type", "pillar", "leaf_agent"]
    return (
        curated.groupBy(*keys)
        .agg(*_exposure())
        .orderBy(F.desc("ssn_prompts"), F.desc("total_prompts"), *keys)
    )


def mentions(entity: Column, terms: Sequence[str]) -> Column:
    """Substring test: 'Line 3' also matches 'Line 30'."""
    return reduce(lambda a, b: a | b, (entity.contains(t) for t in terms))


def incident_story(curated: DataFrame, terms: Sequence[str] = V.INCIDENT_TERMS, sample: str = "first_id") -> DataFrame:
    """Prompts about an incident across pillars, with one sample text per group.

    ``sample="first_id"`` takes the text with the smallest id; ``"any"`` any text.
    """
    keys = ["interaction_type", "pillar", "leaf_agent", "topic_cluster", "functional_intent"]
    text = "prompt_text_masked"
    pick = F.any_value(text) if sample == "any" else F.min_by(text, "insert_id")
    return (
        curated.where(mentions(F.col("operational_entity"), terms))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("prompt_volume"),
            F.count_if(F.col("contains_ssn") & F.col("contains_medical_phi")).alias(
                "ssn_plus_injury_phi_claims"
            ),
            M.hours(F.col("adjusted_minutes_saved")).alias("hours_saved_on_incident"),
            pick.alias("sample_masked_prompt"),
        )
        .orderBy("pillar", "interaction_type", F.desc("prompt_volume"), "leaf_agent",
                 "topic_cluster", "functional_intent")
    )


def _coaching_columns() -> list[Column]:
    c = F.col
    return [
        c("department").alias("business_unit"),
        c(LEVEL).alias("current_maturity_level"),
        c("is_retrieval_gap"),
        c("prompt_text_masked").alias("original_masked_prompt"),
        c("prompt_coaching.missing_elements").alias("missing_elements"),
        c("prompt_coaching.improvement_recommendation").alias("improvement_recommendation"),
        c("prompt_coaching.rewritten_level_3_prompt").alias("rewritten_level_3_prompt"),
        c("prompt_coaching.recommended_target_agent_or_connector").alias(
            "recommended_target_agent_or_connector"
        ),
        c("potential_extra_minutes_unlocked"),
    ]


def _coaching_order() -> list[Column]:
    return [
        F.desc("potential_extra_minutes_unlocked"), F.desc("is_retrieval_gap"), F.asc("insert_id"),
    ]


def coaching_top(curated: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` prompts that gain most from a rewrite; a top-k, not a full sort."""
    return (
        curated.where(F.col("prompt_coaching.needs_improvement"))
        .orderBy(*_coaching_order())
        .limit(n)
        .select("insert_id", *_coaching_columns())
    )


def connector_exposure(curated: DataFrame) -> DataFrame:
    """Sensitive data per enterprise connector."""
    return (
        curated.withColumn("connector", F.explode("connectors_queried"))
        .groupBy("connector")
        .agg(*_exposure())
        .orderBy(F.desc("ssn_prompts"), F.desc("total_prompts"), "connector")
    )


def missing_element_counts(curated: DataFrame) -> DataFrame:
    """How often each prompt element is missing, per business unit."""
    return (
        curated.select(
            F.col("department").alias("business_unit"),
            F.explode("prompt_coaching.missing_elements").alias("missing_element"),
        )
        .groupBy("business_unit", "missing_element")
        .agg(F.count("*").alias("prompts"))
        .orderBy("business_unit", F.desc("prompts"), "missing_element")
    )


def training_priority(curated: DataFrame) -> DataFrame:
    """The unit with the lowest index and, among equals, the strongest search habit."""
    return (
        workforce_maturity(curated)
        .orderBy(
            "workforce_maturity_index_1_to_3", F.desc("search_query_habit_pct"), "business_unit"
        )
        .limit(1)
    )


def gap_without_connector(curated: DataFrame) -> DataFrame:
    """Retrieval gaps where no connector was queried, per unit and knowledge domain."""
    return (
        curated.where(F.col("is_retrieval_gap") & (F.size("connectors_queried") == 0))
        .groupBy(
            F.col("department").alias("business_unit"),
            F.col("grounding_analysis.target_corpus").alias("target_knowledge_corpus"),
        )
        .agg(F.count("*").alias("gap_prompts"))
        .orderBy(F.desc("gap_prompts"), "business_unit", "target_knowledge_corpus")
    )


def fault_to_claim_correlation(curated: DataFrame, fault: str = "ERR-PLC-409") -> DataFrame:
    """Per line: volume by pillar, fault mentions, injury claims, and days with both.

    One scan: counts per line and day first, which then are summed by line.
    """
    entity = F.col("operational_entity")
    line = F.regexp_extract(P.extract_entity(entity), r"Line [0-9]+", 0)
    claim = F.col("contains_ssn") & F.col("contains_medical_phi")
    daily = (
        curated.withColumn("line", line)
        .where(F.col("line") != "")
        .groupBy("line", F.to_date("event_timestamp").alias("day"))
        .agg(
            *(F.count_if(F.col("pillar") == p).alias(f"{p.lower()}_prompts") for p in ("Operations", "Finance", "HR")),
            F.count_if(entity.contains(fault) & (F.col("pillar") == "Operations")).alias("fault_prompts"),
            F.count_if(claim).alias("injury_claims"),
        )
    )
    sums = ("operations_prompts", "finance_prompts", "hr_prompts", "fault_prompts", "injury_claims")
    shared = F.count_if((F.col("fault_prompts") > 0) & (F.col("injury_claims") > 0)).alias("shared_days")
    return daily.groupBy("line").agg(*(F.sum(c).alias(c) for c in sums), shared).orderBy("line")


def risk_distribution(curated: DataFrame) -> DataFrame:
    """Prompts per risk level, most severe first."""
    order = F.array_position(F.array(*(F.lit(r) for r in V.RISK_LEVELS)), F.col("dlp_risk_level"))
    return (
        curated.groupBy("dlp_risk_level").agg(F.count("*").alias("prompts"))
        .orderBy(order)
    )


def shadow_prompts(curated: DataFrame) -> DataFrame:
    """Operations prompts with social security numbers per plant, shift and agent."""
    keys = ["plant_location", "shift", "leaf_agent"]
    return (
        curated.groupBy(*keys)
        .agg(F.count("*").alias("total_prompts"), F.count_if("is_shadow_prompt").alias("shadow_prompts"))
        .where("shadow_prompts > 0")
        .orderBy(F.desc("shadow_prompts"), *keys)
    )


def roi_total(curated: DataFrame) -> DataFrame:
    """Net and extra hours per unit, and the grand total."""
    return (
        curated.rollup("department")
        .agg(
            F.grouping("department").alias("_total"),
            F.count("*").alias("prompt_count"),
            M.hours(F.col("adjusted_minutes_saved")).alias("net_adjusted_hours_saved"),
            M.hours(F.col("potential_extra_minutes_unlocked")).alias("extra_hours_unlocked"),
        )
        .select(
            F.when(F.col("_total") == 1, "ALL UNITS").otherwise(F.col("department")).alias("business_unit"),
            "prompt_count", "net_adjusted_hours_saved", "extra_hours_unlocked", "_total",
        )
        .orderBy("_total", "business_unit")
        .drop("_total")
    )


def dominant_intent(curated: DataFrame) -> DataFrame:
    """Most common intent per interaction type; the window runs over counts only."""
    w = Window.partitionBy("interaction_type").orderBy(F.desc("prompts"), "functional_intent")
    return (
        curated.groupBy("interaction_type", "functional_intent")
        .agg(F.count("*").alias("prompts"))
        .withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .drop("_n")
        .orderBy("interaction_type")
    )


def actor_activity(curated: DataFrame) -> DataFrame:
    """Per actor and day: prompts, mean level and running total.

    Rows are reduced to one per actor and day before the window.
    """
    w = Window.partitionBy("anonymous_actor_hash").orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        curated.groupBy("anonymous_actor_hash", F.to_date("event_timestamp").alias("day"))
        .agg(
            F.count("*").alias("prompts"),
            F.round(F.avg(M.level_index(F.col(LEVEL))), 2).alias("mean_level"),
        )
        .withColumn("running_prompts", F.sum("prompts").over(w))
    )


PERFORMANCE = ["latency_ms", "prompt_tokens", "response_tokens"]


def performance_summary(curated: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, median, 95th percentile and maximum of latency and tokens per type and agent.

    Exact percentiles are read off running counts of the distinct values, which a task sorts (on disk
    if need be) rather than holds. ``approximate`` trades exactness for one mergeable sketch per group.
    """
    keys = ["interaction_type", "leaf_agent", "metric"]
    long = curated.select(
        "interaction_type", "leaf_agent",
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in PERFORMANCE))),
    ).where("v is not null")
    counted = long.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))

    def quantile(p: float) -> Column:
        """Linear between the two values whose ranks enclose the quantile."""
        place = (F.col("all") - 1) * p
        low, high = (F.min(F.when(F.col("upto") > edge(place), F.col("v"))) for edge in (F.floor, F.ceil))
        return low + (high - low) * F.max(place - F.floor(place))

    if approximate:
        n, source = F.lit(1), long
        quantile = lambda p: F.percentile_approx("v", p, 10_000).cast("double")
    else:
        n, source = F.col("n"), ranked
    return source.groupBy(*keys).agg(
        F.sum(n).cast("bigint").alias("prompts"),
        F.round(F.sum(F.col("v") * n) / F.sum(n), 2).alias("mean"),
        F.round(quantile(0.5), 2).alias("p50"),
        F.round(quantile(0.95), 2).alias("p95"),
        F.max("v").alias("max"),
    ).orderBy(*keys)


def delegation_edges(curated: DataFrame) -> DataFrame:
    """Caller to callee counts along agent paths of two or more hops."""
    hops = F.split("agent_tree_path", V.PATH_SEPARATOR)
    pairs = F.zip_with(
        F.slice("h", F.lit(1), F.size("h") - 1), F.slice("h", F.lit(2), F.size("h") - 1),
        lambda a, b: F.struct(a.alias("caller"), b.alias("callee")),
    )
    return (
        curated.where(F.col("interaction_type") != V.CHAT)
        .select(hops.alias("h"))
        .groupBy("h").agg(F.count("*").alias("n"))
        .where(F.size("h") > 1)
        .select("n", F.inline(pairs))
        .groupBy("caller", "callee").agg(F.sum("n").alias("calls"))
        .orderBy("caller", "callee")
    )


def recommended_vs_actual(curated: DataFrame) -> DataFrame:
    """How often the recommended agent or connector was the one in use."""
    target = F.col("prompt_coaching.recommended_target_agent_or_connector")
    used = (F.col("leaf_agent") == target) | F.array_contains("connectors_queried", target)
    return (
        curated.groupBy(target.alias("recommended"))
        .agg(
            F.count("*").alias("prompts"),
            F.count_if(used).alias("already_used"),
            M.pct(F.count_if(used), F.count("*")).alias("already_used_pct"),
        )
        .orderBy(F.desc("prompts"), "recommended")
    )


def rewrites_by_unit(curated: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best coaching rows of every unit.

    Each task keeps at most ``k`` rows per unit before the shuffle (window group limit).
    """
    w = Window.partitionBy("department").orderBy(*_coaching_order())
    return (
        curated.where(F.col("prompt_coaching.needs_improvement"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("rank", "insert_id", *_coaching_columns())
        .orderBy("business_unit", "rank")
    )


def search_habit_by_actor(curated: DataFrame) -> DataFrame:
    """Share of search-style prompts per actor, worst first."""
    n = F.count("*")
    return (
        curated.groupBy("anonymous_actor_hash")
        .agg(
            n.alias("total_prompts"),
            F.count_if(SEARCH).alias("search_style_prompts"),
            M.pct(F.count_if(SEARCH), n).alias("search_habit_pct"),
        )
        .orderBy(F.desc("search_habit_pct"), F.desc("total_prompts"), "anonymous_actor_hash")
    )


def unit_hours(curated: DataFrame, keys: Sequence[str] = ("department",)) -> DataFrame:
    """Net hours saved per key."""
    return curated.groupBy(*keys).agg(
        M.hours(F.col("adjusted_minutes_saved")).alias("net_hours")
    ).orderBy(*keys)
