"""Declared schemas: raw log entries, judge object and the 40-column curated table."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)

CORRUPT = "_corrupt_record"


def _f(name: str, dtype: T.DataType, comment: str = "", nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable, {"comment": comment} if comment else {})


# Fields that senders type loosely are read as text, numbers as variants, and converted afterwards:
# one wrongly typed field would otherwise turn the whole row into a corrupt record. Fields that
# nothing reads are not declared.
PAYLOAD = T.StructType(
    [
        _f(name, STRING)
        for name in (
            "event_type", "interaction_type", "session_id", "employee_id", "employee_name",
            "employee_email", "department", "employee_role", "plant_location", "shift", "pillar",
            "root_agent", "leaf_agent", "agent_tree_path", "agent_invoked", "ge_app_id",
            "prompt_text", "operational_entity", "topic_cluster",
        )
    ]
    + [_f(name, T.VariantType()) for name in ("latency_ms", "prompt_tokens", "response_tokens")]
    + [_f("connectors_queried", STRINGS)]
)

LOG_ENTRY = T.StructType(
    [
        _f("insertId", STRING),
        _f("logName", STRING),
        _f("timestamp", STRING),
        _f("severity", STRING),
        _f("trace", STRING),
        _f("spanId", STRING),
        _f("jsonPayload", PAYLOAD),
        _f(CORRUPT, STRING),
    ]
)

#: Fields of which a present null isn't an absent field.
NULLABLE_FIELDS = ["department", "employee_role", "plant_location", "shift", "pillar"]


def strict_entry() -> T.StructType:
    """The log entry with those fields as variants, which tell null from absent, of the same single parse."""
    payload = T.StructType([_f(f.name, T.VariantType() if f.name in NULLABLE_FIELDS else f.dataType) for f in PAYLOAD])
    return T.StructType([_f(f.name, payload if f.name == "jsonPayload" else f.dataType) for f in LOG_ENTRY])


ROSTER = T.StructType(
    [
        _f(name, STRING)
        for name in (
            "employee_id", "employee_name", "employee_email", "anonymous_actor_hash",
            "department", "role", "plant_location", "shift",
        )
    ]
)

MATURITY = T.StructType(
    [
        _f("level", STRING, "Maturity level: level_1_underspecified, level_2_basic_directive or level_3_well_engineered"),
        _f("has_persona", BOOL, "The prompt assigns a role or persona"),
        _f("has_explicit_format", BOOL, "The prompt asks for a named output format"),
        _f("has_constraints", BOOL, "The prompt sets limits on length, scope or time"),
        _f("is_search_query_style", BOOL, "The prompt is a three to five word keyword query"),
    ]
)

GROUNDING = T.StructType(
    [
        _f("grounding_type", STRING, "enterprise_rag, in_context_attachment or parametric_general"),
        _f("requires_enterprise_knowledge", BOOL, "A correct answer needs internal records or policies"),
        _f("target_corpus", STRING, "Knowledge domain: hr_policy, product_docs, sales_collateral, it_support, codebase or unknown"),
    ]
)

COACHING = T.StructType(
    [
        _f("needs_improvement", BOOL, "Maturity, grounding or data minimisation can be improved"),
        _f("missing_elements", STRINGS, "What the prompt lacks, from a list of five elements"),
        _f("improvement_recommendation", STRING, "One or two sentences of advice"),
        _f("rewritten_level_3_prompt", STRING, "The prompt rewritten with role, format, limits and grounding"),
        _f("recommended_target_agent_or_connector", STRING, "The agent or connector best suited to the task"),
    ]
)

JUDGE = T.StructType(
    [
        _f("functional_intent", STRING),
        _f("task_complexity", STRING),
        _f("specification_maturity", MATURITY),
        _f("grounding_analysis", GROUNDING),
        _f("estimated_manual_minutes", LONG),
        _f("prompt_coaching", COACHING),
    ]
)

_CURATED = T.StructType(
    [
        _f("insert_id", STRING, "Unique id of the log entry; key for duplicate removal", False),
        _f("event_timestamp", T.TimestampType(), "When the prompt was submitted (UTC)", False),
        _f("interaction_type", STRING, "Chat with connector search, or agent tree execution", False),
        _f("trace_id", STRING, "Trace id, last path segment only"),
        _f("span_id", STRING, "Span id"),
        _f("anonymous_actor_hash", STRING, "Keyed one-way hash of the sender's email", False),
        _f("department", STRING, "Business unit of the sender"),
        _f("employee_role", STRING, "Job title of the sender"),
        _f("plant_location", STRING, "Site of the sender"),
        _f("shift", STRING, "Working shift of the sender"),
        _f("pillar", STRING, "Business pillar the prompt was handled by"),
        _f("root_agent", STRING, "Lead agent of the pillar, or the native-chat marker"),
        _f("leaf_agent", STRING, "Agent that did the work, or the native-chat marker"),
        _f("agent_tree_path", STRING, "Hops through the agent tree, or the chat window with its connectors"),
        _f("connectors_queried", STRINGS, "Data connectors searched by the chat"),
        _f("prompt_text_masked", STRING, "Prompt after de-identification"),
        _f("dlp_detected", BOOL, "At least one sensitive information type was found"),
        _f("dlp_risk_level", STRING, "NONE, LOW, MEDIUM, HIGH or CRITICAL"),
        _f("dlp_finding_count", LONG, "Number of distinct information types found"),
        _f("dlp_info_types", STRINGS, "Sorted distinct information types found"),
        _f("contains_ssn", BOOL, "A social security number was found and masked"),
        _f("contains_medical_phi", BOOL, "A medical term was found"),
        _f("contains_financial_acct", BOOL, "A bank account number was found and masked"),
        _f("is_toxic_combination", BOOL, "Social security number together with medical or bank data"),
        _f("is_shadow_prompt", BOOL, "A social security number pasted by Operations staff"),
        _f("operational_entity", STRING, "Line, fault code or lot the prompt is about"),
        _f("topic_cluster", STRING, "Topic of the prompt"),
        _f("functional_intent", STRING, "One of six intents"),
        _f("task_complexity", STRING, "low, medium or high"),
        _f("specification_maturity", MATURITY, "How well the prompt is specified"),
        _f("grounding_analysis", GROUNDING, "What the answer is grounded on"),
        _f("is_retrieval_gap", BOOL, "Internal knowledge was needed but nothing was retrieved"),
        _f("estimated_manual_minutes", LONG, "Manual effort: 5, 15 or 45 minutes by complexity"),
        _f("maturity_multiplier", DOUBLE, "0.5, 0.75 or 1.0 by maturity level"),
        _f("adjusted_minutes_saved", DOUBLE, "Manual minutes times multiplier"),
        _f("potential_extra_minutes_unlocked", DOUBLE, "Minutes gained by a level 3 rewrite"),
        _f("prompt_coaching", COACHING, "Advice, missing elements and rewrite"),
        _f("latency_ms", LONG, "End-to-end latency in milliseconds"),
        _f("prompt_tokens", LONG, "Input tokens"),
        _f("response_tokens", LONG, "Output tokens"),
    ]
)

NOT_NULL = [f.name for f in _CURATED.fields if not f.nullable]
CLUSTER_KEYS = ["interaction_type", "pillar", "functional_intent", "dlp_risk_level"]


def curated_schema() -> T.StructType:
    """The curated table: 40 columns, each with a description."""
    return _CURATED
