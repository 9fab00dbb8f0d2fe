"""Checked queries: sources, sinks and projections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    DETECTORS, check, curated, delivered, disturbed, entries, events, flat, joined, masked, stamp,
    test_key,
)
from checks.telemetry_sql import sql
from promptlens import fixed_values as V
from promptlens.functions import payload as P
from promptlens.operators import curate as C
from promptlens.operators.compact import compact, vacuum
from promptlens.operators.ledger import append_once
from promptlens.operators import enrich as E
from promptlens.operators.normalize import flatten
from promptlens.operators.judge import judge_with
from promptlens.schema import curated_schema
from promptlens.session import scratch_path
from promptlens.sources import dimensions as Dim
from promptlens.sources import logs as L
from checks import telemetry as T

TS = "strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%g') AS event_timestamp"


# ---- sources and sinks ---------------------------------------------------------


def _log_files(spark: SparkSession, sf: str) -> dict[str, str]:
    """Both streams as JSON-lines files."""
    rows = T.entry_json(events(spark, sf))
    paths = {"chat": scratch_path(spark, "chat"), "agent": scratch_path(spark, "agent")}
    for name, kind in (("chat", V.CHAT), ("agent", V.AGENT)):
        rows.where(F.col("mode") == kind).select("value").write.text(paths[name])
    return paths


@check("s1_read_log_jsonl", sql("SELECT insert_id, log_name, severity, prompt_text FROM flat", upto="flat"))
def read_log_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    paths = _log_files(spark, sf)
    e = F.col("entry")
    return L.read_log_jsonl(spark, list(paths.values())).where(~L.is_corrupt(e)).select(
        e["insertId"].alias("insert_id"), e["logName"].alias("log_name"), e["severity"].alias("severity"),
        e["jsonPayload"]["prompt_text"].alias("prompt_text"),
    )


@check(
    "s2_read_streams",
    sql("SELECT log_name, count(*) AS n, min(insert_id) AS first_id, max(insert_id) AS last_id FROM flat GROUP BY log_name", upto="flat"),
)
def read_streams(spark: SparkSession, sf: str) -> DataFrame:
    return L.read_streams(spark, _log_files(spark, sf), "all").groupBy("log_name").agg(
        F.count("*").alias("n"), F.min("entry.insertId").alias("first_id"),
        F.max("entry.insertId").alias("last_id"),
    )


@check("s3_decode_messages", sql("SELECT 'msg-' || id AS event_id, insert_id, span_id, prompt_text FROM flat", upto="flat"))
def decode(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(
        "event_id", F.col("entry.insertId").alias("insert_id"), F.col("entry.spanId").alias("span_id"),
        F.col("entry.jsonPayload.prompt_text").alias("prompt_text"),
    )


@check("s4_drop_empty_messages", sql("SELECT event_id FROM msg WHERE NOT empty", upto="delivered"))
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    return L.drop_empty_messages(disturbed(spark, sf)).select("event_id")


@check(
    "s5_quarantine_malformed",
    sql("SELECT event_id, CASE WHEN broken THEN 'malformed' ELSE 'good' END AS state FROM msg WHERE NOT empty", upto="delivered"),
)
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = L.quarantine_malformed(disturbed(spark, sf))
    return good.select("event_id", F.lit("good").alias("state")).unionByName(
        bad.select("event_id", F.col("reason").alias("state"))
    )


@check(
    "s6_route_logs",
    sql(
        "SELECT 'projects/demo/logs/' || log_name AS log_name, count(*) AS n FROM flat WHERE shift <> 'Shift 3' GROUP BY 1",
        upto="flat",
    ),
)
def route(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("entry.jsonPayload")
    named = entries(spark, sf).withColumn(
        "log_name",
        F.when(p["shift"] == "Shift 3", F.lit("projects/demo/logs/other")).otherwise(
            F.concat(F.lit("projects/demo/logs/"), F.col("entry.logName"))
        ),
    )
    return L.route_logs(named).groupBy("log_name").agg(F.count("*").alias("n"))


@check("s7_parse_event_time", sql(f"SELECT insert_id, {TS} FROM flat", upto="flat"))
def event_time(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("insert_id", stamp())


@check(
    "s8_attach_labels",
    sql(
        "SELECT insert_id, 'interaction_type=' || interaction_type || ',pillar=' || pillar || ',plant_location=' || plant"
        " || ',simulated_service=' || CASE WHEN chat THEN 'discoveryengine.googleapis.com' ELSE 'aiplatform.googleapis.com/ReasoningEngine' END"
        " || ',telemetry=prompt-analytics' AS labels FROM flat",
        upto="flat",
    ),
)
def attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return L.attach_labels(entries(spark, sf)).select(
        F.col("entry.insertId").alias("insert_id"), F.array_join(pairs, ",").alias("labels")
    )


@check("s9_default_severity", sql("SELECT insert_id, coalesce(severity, 'INFO') AS severity FROM flat", upto="flat"))
def severity_default(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(
        F.col("entry.insertId").alias("insert_id"),
        P.default_severity(F.col("entry.severity")).alias("severity"),
    )


@check(
    "s10_derive_severity",
    sql("SELECT insert_id, CASE WHEN len(info_types) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM masked", upto="masked"),
)
def severity_derived(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select(
        "insert_id", P.derive_severity(F.col("dlp_detected")).alias("severity")
    )


@check("s11_restamp_trace", sql("SELECT insert_id, 'projects/target/traces/' || trace_id AS trace FROM flat", upto="flat"))
def trace(spark: SparkSession, sf: str) -> DataFrame:
    return entries(spark, sf).select(
        F.col("entry.insertId").alias("insert_id"),
        P.restamp_trace(F.col("entry.trace"), "target").alias("trace"),
    )


@check(
    "s12_micro_batch",
    "SELECT 'all rows' AS what, count(*) AS n FROM events UNION ALL SELECT 'largest call', least(250, count(*)) FROM events",
)
def micro_batch(spark: SparkSession, sf: str) -> DataFrame:
    """External calls get 250 records each at most, and just as many where there are more."""

    def client_factory():
        return lambda batch: [json.dumps({"calls": len(batch)})] * len(batch)

    rows = masked(spark, sf)
    # of so few tasks that one has a full call at least; a large input keeps all of them
    tasks = max(1, entries(spark, sf).count() // V.CHUNK_ROWS)
    judged = judge_with(rows.coalesce(tasks), client_factory)
    size = F.get_json_object("judge_json", "$.calls").cast("bigint")
    counts = judged.agg(F.count("*").alias("rows"), F.max(size).alias("largest"))
    return counts.select(F.inline(F.array(F.struct(F.lit("all rows").alias("what"), F.col("rows").alias("n")), F.struct(F.lit("largest call").alias("what"), F.col("largest").alias("n")))))


@check(
    "s13_read_roster",
    sql(
        "SELECT DISTINCT employee_id, employee_email, 'usr_' || left(sha256('cme-ge-dlp-actor-domain-v1:' || employee_email), 8)"
        " AS anonymous_actor_hash, department, role, plant AS plant_location, shift FROM flat",
        upto="flat",
    ),
)
def roster(spark: SparkSession, sf: str) -> DataFrame:
    from promptlens.functions.hashing import salted_actor_hash

    path = scratch_path(spark, "roster")
    T.roster(events(spark, sf)).withColumn(
        "anonymous_actor_hash", salted_actor_hash(F.col("employee_email"))
    ).write.json(path)
    return Dim.read_roster(spark, path, multi_line=False).drop("employee_name")


@check(
    "s14_agent_catalog",
    sql("SELECT agent_num, agent AS id, pillar, agent_tree_path AS path, count(*) AS prompts FROM flat WHERE NOT chat GROUP BY ALL", upto="flat"),
)
def catalog(spark: SparkSession, sf: str) -> DataFrame:
    counts = flat(spark, sf).where(F.col("interaction_type") != V.CHAT).groupBy(
        F.col("leaf_agent").alias("id")
    ).agg(F.count("*").alias("prompts"))
    return counts.join(F.broadcast(Dim.agent_catalog(spark)), "id").select(
        "agent_num", "id", "pillar", F.array_join("tree_path", V.PATH_SEPARATOR).alias("path"), "prompts"
    )


@check(
    "s15_write_curated",
    sql("SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, interaction_type, pillar, functional_intent, dlp_risk_level, count(*) AS n FROM curated GROUP BY ALL"),
)
def write_curated(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "written")
    C.write_curated(curated(spark, sf).drop("event_date"), path)
    return C.read_curated(spark, path).groupBy(
        F.col("event_date").cast("string").alias("event_date"),
        "interaction_type", "pillar", "functional_intent", "dlp_risk_level",
    ).agg(F.count("*").alias("n"))


_SQL_COLUMNS = [
    "insert_id", "event_timestamp", "interaction_type", "trace_id", "span_id", "anonymous_actor_hash",
    "department", "role", "plant", "shift", "pillar", "root_agent", "leaf_agent", "agent_tree_path",
    "connectors", "prompt_text_masked", "info_types", "dlp_risk_level", "info_types", "info_types",
    "f_ssn", "f_med", "f_acct", "is_toxic_combination", "is_shadow_prompt", "entity", "topic",
    "functional_intent", "task_complexity", "level", "grounding_type", "is_retrieval_gap", "minutes",
    "maturity_multiplier", "adjusted_minutes_saved", "potential_extra_minutes_unlocked",
    "recommendation", "latency_ms", "prompt_tokens", "response_tokens",
]


# --- fixed values: the stored table, written out (position, name, description) ---
STORED = [
    (1, "insert_id", "Unique id of the log entry; key for duplicate removal"),
    (2, "event_timestamp", "When the prompt was submitted (UTC)"),
    (3, "interaction_type", "Chat with connector search, or agent tree execution"),
    (4, "trace_id", "Trace id, last path segment only"),
    (5, "span_id", "Span id"),
    (6, "anonymous_actor_hash", "Keyed one-way hash of the sender's email"),
    (7, "department", "Business unit of the sender"),
    (8, "employee_role", "Job title of the sender"),
    (9, "plant_location", "Site of the sender"),
    (10, "shift", "Working shift of the sender"),
    (11, "pillar", "Business pillar the prompt was handled by"),
    (12, "root_agent", "Lead agent of the pillar, or the native-chat marker"),
    (13, "leaf_agent", "Agent that did the work, or the native-chat marker"),
    (14, "agent_tree_path", "Hops through the agent tree, or the chat window with its connectors"),
    (15, "connectors_queried", "Data connectors searched by the chat"),
    (16, "prompt_text_masked", "Prompt after de-identification"),
    (17, "dlp_detected", "At least one sensitive information type was found"),
    (18, "dlp_risk_level", "NONE, LOW, MEDIUM, HIGH or CRITICAL"),
    (19, "dlp_finding_count", "Number of distinct information types found"),
    (20, "dlp_info_types", "Sorted distinct information types found"),
    (21, "contains_ssn", "A social security number was found and masked"),
    (22, "contains_medical_phi", "A medical term was found"),
    (23, "contains_financial_acct", "A bank account number was found and masked"),
    (24, "is_toxic_combination", "Social security number together with medical or bank data"),
    (25, "is_shadow_prompt", "A social security number pasted by Operations staff"),
    (26, "operational_entity", "Line, fault code or lot the prompt is about"),
    (27, "topic_cluster", "Topic of the prompt"),
    (28, "functional_intent", "One of six intents"),
    (29, "task_complexity", "low, medium or high"),
    (30, "specification_maturity", "How well the prompt is specified"),
    (31, "grounding_analysis", "What the answer is grounded on"),
    (32, "is_retrieval_gap", "Internal knowledge was needed but nothing was retrieved"),
    (33, "estimated_manual_minutes", "Manual effort: 5, 15 or 45 minutes by complexity"),
    (34, "maturity_multiplier", "0.5, 0.75 or 1.0 by maturity level"),
    (35, "adjusted_minutes_saved", "Manual minutes times multiplier"),
    (36, "potential_extra_minutes_unlocked", "Minutes gained by a level 3 rewrite"),
    (37, "prompt_coaching", "Advice, missing elements and rewrite"),
    (38, "latency_ms", "End-to-end latency in milliseconds"),
    (39, "prompt_tokens", "Input tokens"),
    (40, "response_tokens", "Output tokens"),
]


@check(
    "s16_curated_schema",
    sql(
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{name}' AS name, count({c}) AS filled FROM curated" for (i, name, _), c in zip(STORED, _SQL_COLUMNS)
        )
    ),
)
def schema(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored column with its position and number of filled rows."""
    table = curated(spark, sf).drop("event_date")
    counts = table.agg(*(F.count(c).alias(c) for c in table.columns))
    columns = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(c).alias("filled")) for i, c in enumerate(table.columns, 1)]
    return counts.select(F.inline(F.array(*columns)))


@check(
    "uf4_column_descriptions",
    "SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, name, text in STORED) + ") t(position, name, description), (SELECT count(*) AS messages FROM events)",
)
def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Names and descriptions as the written table has them, and its number of rows."""
    table = curated(spark, sf).drop("event_date")
    fields = [(i, f.name, f.metadata.get("comment")) for i, f in enumerate(table.schema, 1)]
    rows = spark.createDataFrame(fields, "position int, name string, description string")
    return rows.withColumn("messages", table.agg(F.count("*").alias("messages")).select("messages").scalar())


@check(
    "s17_require_not_null",
    sql(
        "SELECT CASE WHEN shift = 'Shift 2' THEN 'missing or invalid anonymous_actor_hash'"
        " WHEN plant = 'Aldermoor' THEN 'missing or invalid prompt_tokens' ELSE 'complete' END AS reason, count(*) AS n FROM flat GROUP BY 1",
        upto="flat",
    ),
)
def not_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = masked(spark, sf).withColumns(
        {
            "anonymous_actor_hash": F.when(F.col("shift") != "Shift 2", F.col("anonymous_actor_hash")),
            "prompt_tokens": F.when(F.col("plant_location") != "Aldermoor", F.col("prompt_tokens")),
        }
    )
    good, bad = C.require_not_null(rows)
    both = good.select(F.lit("complete").alias("reason")).unionByName(bad.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


@check(
    "s18_idempotent_append",
    sql(
        "SELECT department, count(*) AS n, count(DISTINCT insert_id) AS ids FROM"
        " accepted GROUP BY 1",
        upto="delivered",
    ),
)
def append(spark: SparkSession, sf: str) -> DataFrame:
    """The same deliveries appended twice leave one row per id."""
    path = scratch_path(spark, "appended")
    rows = C.curate(disturbed(spark, sf), DETECTORS, test_key(spark))
    append_once(rows, path)
    append_once(rows, path)
    return C.read_curated(spark, path).groupBy("department").agg(
        F.count("*").alias("n"), F.countDistinct("insert_id").alias("ids")
    )


@check(
    "s20_export_jsonl",
    sql("SELECT department, level, count(*) AS n, sum(minutes)::BIGINT AS minutes FROM curated GROUP BY ALL"),
)
def export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "export")
    C.export_jsonl(curated(spark, sf).drop("event_date"), path)
    return spark.read.schema(curated_schema()).json(path).groupBy(
        "department", F.col("specification_maturity.level").alias("level")
    ).agg(F.count("*").alias("n"), F.sum("estimated_manual_minutes").alias("minutes"))


@check("s21_split_by_stream", sql("SELECT interaction_type, count(*) AS n, sum(latency_ms)::BIGINT AS latency FROM flat GROUP BY 1", upto="flat"))
def split(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "split")
    C.split_by_stream(curated(spark, sf).drop("event_date"), path)
    return spark.read.schema(curated_schema()).json(path).groupBy("interaction_type").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency")
    )


# ---- projections ---------------------------------------------------------------


@check(
    "p1_payload_get",
    sql("SELECT event_id, department, role AS employee_role, plant AS plant_location, shift, pillar FROM delivered", upto="delivered"),
)
def payload_get(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("entry.jsonPayload")
    names = ["department", "employee_role", "plant_location", "shift", "pillar"]
    return L.decode_messages(disturbed(spark, sf)).select(
        "event_id", *(P.field_or(p[n], "Unknown").alias(n) for n in names)
    )


@check("p2_default_interaction_type", sql("SELECT interaction_type, count(*) AS n FROM delivered GROUP BY 1", upto="delivered"))
def default_type(spark: SparkSession, sf: str) -> DataFrame:
    return delivered(spark, sf).groupBy("interaction_type").agg(F.count("*").alias("n"))


@check("p3_connectors_or_empty", sql("SELECT insert_id, len(connectors)::INT AS n FROM flat", upto="flat"))
def connectors(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("insert_id", F.size("connectors_queried").alias("n"))


@check("p4_project_chat", sql("SELECT insert_id, root_agent, leaf_agent FROM flat WHERE chat", upto="flat"))
def project_chat(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).where(F.col("interaction_type") == V.CHAT).select(
        "insert_id", "root_agent", "leaf_agent"
    )


@check("p5_chat_path_string", sql("SELECT insert_id, agent_tree_path FROM flat WHERE chat", upto="flat"))
def chat_path(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).where(F.col("interaction_type") == V.CHAT).select("insert_id", "agent_tree_path")


@check("p6_project_agent", sql("SELECT insert_id, root_agent, leaf_agent FROM flat WHERE NOT chat", upto="flat"))
def project_agent(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).where(F.col("interaction_type") == V.AGENT).select(
        "insert_id", "root_agent", "leaf_agent"
    )


@check(
    "p7_agent_path_string",
    sql(
        "SELECT insert_id, again, CASE WHEN id % 227 = 0 AND NOT again THEN 'direct call' ELSE agent_tree_path END AS agent_tree_path"
        " FROM delivered WHERE NOT chat",
        upto="delivered",
    ),
)
def agent_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.decode_messages(disturbed(spark, sf))
    p = F.col("entry.jsonPayload")
    return rows.where(P.field_or(p["interaction_type"], V.AGENT) == V.AGENT).select(
        F.col("entry.insertId").alias("insert_id"), F.col("event_id").startswith("again").alias("again"),
        P.agent_path(p["agent_tree_path"]).alias("agent_tree_path"),
    )


@check("p8_trace_tail", sql("SELECT insert_id, trace_id FROM flat", upto="flat"))
def trace_tail(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("insert_id", "trace_id")


@check(
    "p9_insert_id_or_event_id",
    sql("SELECT CASE WHEN shift = 'Shift 1' OR shift = 'Shift 2' THEN 'msg-' || id ELSE insert_id END AS insert_id, span_id FROM flat", upto="flat"),
)
def insert_id(spark: SparkSession, sf: str) -> DataFrame:
    shift = F.col("entry.jsonPayload.shift")
    given = F.when(shift == "Shift 1", "").when(shift == "Shift 3", F.col("entry.insertId"))
    return entries(spark, sf).select(
        P.insert_id_or_event_id(given, F.col("event_id")).alias("insert_id"),
        F.col("entry.spanId").alias("span_id"),
    )


@check(
    "p10_to_int",
    sql(
        "SELECT event_id, CASE WHEN junk THEN NULL WHEN NOT again AND id % 229 = 0 THEN 12 ELSE latency_ms END AS latency_ms, prompt_tokens, response_tokens FROM delivered",
        upto="delivered",
    ),
)
def to_int(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("entry.jsonPayload")
    return L.decode_messages(disturbed(spark, sf)).select(
        "event_id", *(P.to_int(p[n]).alias(n) for n in ("latency_ms", "prompt_tokens", "response_tokens"))
    )


@check("p11_drop_identity", sql("SELECT department, count(*) AS n, 0 AS with_email, 0 AS with_name, 40 AS columns FROM flat GROUP BY 1", upto="flat"))
def drop_identity(spark: SparkSession, sf: str) -> DataFrame:
    table = curated(spark, sf).drop("event_date")
    text = F.to_json(F.struct(*table.columns))
    return table.groupBy("department").agg(
        F.count("*").alias("n"),
        F.count_if(text.contains("@plant.example") | text.contains("@temp.example")).cast("int").alias("with_email"),
        F.count_if(text.rlike("User [0-9]|EMP-[0-9]")).cast("int").alias("with_name"),
        F.lit(len(table.columns)).alias("columns"),
    )


@check("p12_passthrough_defaults", sql("SELECT insert_id, span_id, entity AS operational_entity, topic AS topic_cluster FROM flat", upto="flat"))
def passthrough(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("insert_id", "span_id", "operational_entity", "topic_cluster")


@check(
    "p13_curate",
    sql(
        f"SELECT insert_id, {TS}, interaction_type, trace_id, span_id, anonymous_actor_hash, department, role AS employee_role,"
        " plant AS plant_location, shift, pillar, root_agent, leaf_agent, agent_tree_path,"
        " coalesce(array_to_string(connectors, ','), '') AS connectors_queried, prompt_text_masked, len(info_types) > 0 AS dlp_detected,"
        " dlp_risk_level, len(info_types) AS dlp_finding_count, coalesce(array_to_string(info_types, ','), '') AS dlp_info_types, f_ssn AS contains_ssn,"
        " f_med AS contains_medical_phi, f_acct AS contains_financial_acct, is_toxic_combination, is_shadow_prompt,"
        " entity AS operational_entity, topic AS topic_cluster, functional_intent, task_complexity, level, has_persona,"
        " has_explicit_format, has_constraints, is_search_query_style, grounding_type, requires_enterprise_knowledge,"
        " target_corpus, is_retrieval_gap, minutes AS estimated_manual_minutes, maturity_multiplier, adjusted_minutes_saved,"
        " potential_extra_minutes_unlocked, needs_improvement, coalesce(array_to_string(missing_elements, ','), '') AS missing_elements,"
        " recommendation AS improvement_recommendation, rewritten AS rewritten_level_3_prompt,"
        " recommended_target AS recommended_target_agent_or_connector, latency_ms, prompt_tokens, response_tokens FROM curated"
    ),
)
def full_row(spark: SparkSession, sf: str) -> DataFrame:
    """All 40 columns, nested fields as columns of their own."""
    flat_columns = []
    for f in curated_schema().fields:
        if f.name == "event_timestamp":
            flat_columns.append(stamp())
        elif f.dataType.typeName() == "struct":
            for inner in f.dataType.fields:
                col = F.col(f"{f.name}.{inner.name}")
                flat_columns.append(
                    joined(col, inner.name) if inner.dataType.typeName() == "array" else col.alias(inner.name)
                )
        elif f.dataType.typeName() == "array":
            flat_columns.append(joined(f.name))
        else:
            flat_columns.append(F.col(f.name))
    return curated(spark, sf).select(*flat_columns)


@check(
    "p14_extract_entity",
    sql(
        "SELECT insert_id, concat_ws(' / ', nullif(concat_ws(' ', nullif(regexp_extract(prompt_text_masked, 'Line [0-9]+'), ''),"
        " CASE WHEN regexp_matches(prompt_text_masked, 'ERR-[A-Z]+-[0-9]+') THEN '(' || regexp_extract(prompt_text_masked, 'ERR-[A-Z]+-[0-9]+') || ')' END), ''),"
        " nullif(regexp_extract(prompt_text_masked, 'Lot #[0-9]+'), '')) AS entity FROM masked",
        upto="masked",
    ),
)
def entity(spark: SparkSession, sf: str) -> DataFrame:
    return curated(spark, sf).select(
        "insert_id", P.extract_entity(F.col("prompt_text_masked")).alias("entity")
    )


@check("p15_pillar_of", sql("SELECT insert_id, pillar, pillar <> department AS crossed FROM flat", upto="flat"))
def pillar(spark: SparkSession, sf: str) -> DataFrame:
    catalog_rows = Dim.agent_catalog(spark).select(
        F.col("id").alias("leaf_agent"), F.col("pillar").alias("agent_pillar")
    )
    out = E.pillar_of(F.col("interaction_type"), F.col("department"), F.col("agent_pillar"))
    return (
        flat(spark, sf).select("insert_id", "interaction_type", "department", "leaf_agent")
        .join(F.broadcast(catalog_rows), "leaf_agent", "left")
        .select("insert_id", out.alias("pillar"), (out != F.col("department")).alias("crossed"))
    )


@check(
    "fn13_title_and_capitalize",
    sql(
        "SELECT insert_id, array_to_string(list_transform(string_split(lower(nam), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,"
        " upper(left(prompt_text, 1)) || lower(substr(prompt_text, 2)) AS capitalized FROM flat",
        upto="flat",
    ),
)
def title(spark: SparkSession, sf: str) -> DataFrame:
    """Names as they are written, and texts as sentences."""
    names = F.element_at(F.array(*(F.lit(n.upper()) for n in T.SUBJECT_NAMES)), (F.floor(F.col("event_id") / 7) % len(T.SUBJECT_NAMES)).cast("int") + 1)
    rows = T.prompts(events(spark, sf))
    insert_id = F.concat(F.lit("log-"), F.col("event_id").cast("string")).alias("insert_id")
    return rows.select(insert_id, P.title(names).alias("title"), P.capitalize(F.col("prompt_text")).alias("capitalized"))


_FIELDS = {"department": "Unknown", "employee_role": "Unknown", "plant_location": "Unknown", "shift": "Unknown", "pillar": "Unknown"}


@check(
    "p1_null_is_not_absent",
    "SELECT event_id AS id, " + ", ".join(
        f"CASE event_id // {3 ** i} % 3 WHEN 0 THEN '{default}' WHEN 2 THEN 'v' || user_id END AS {name}" for i, (name, default) in enumerate(_FIELDS.items())
    ) + ", 'Unknown' AS loose FROM events",
)
def strict_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every pattern of absent, null and given over the five fields; loosely read, null counts as absent."""
    id, user = F.col("event_id").cast("bigint"), F.col("user_id").cast("string")

    def field(i: int, name: str) -> F.Column:
        case = F.floor(id / 3**i) % 3
        return F.when(case == 1, f'"{name}": null').when(case == 2, F.concat(F.lit(f'"{name}": "v'), user, F.lit('"')))

    body = F.concat_ws(", ", *(field(i, name) for i, name in enumerate(_FIELDS)))
    text = F.concat(F.lit('{"insertId": "'), id.cast("string"), F.lit('", "jsonPayload": {'), body, F.lit("}}"))
    sent = events(spark, sf).select(id.cast("string").alias("event_id"), F.base64(text.cast("binary")).alias("data"))
    strict = flatten(L.decode_messages(sent, strict=True)).select("insert_id", *_FIELDS)
    nulls = F.base64(F.lit('{"jsonPayload": {"shift": null}}').cast("binary"))
    loose = flatten(L.decode_messages(sent.select("event_id", nulls.alias("data")))).select("insert_id", F.col("shift").alias("loose"))
    return strict.join(loose, "insert_id").select(F.col("insert_id").cast("bigint").alias("id"), *_FIELDS, "loose")


@check(
    "s15_compacted",
    sql("SELECT strftime(event_timestamp, '%Y-%m-%d') AS event_date, interaction_type, count(*) AS n, count(DISTINCT insert_id) AS ids FROM curated GROUP BY ALL"),
)
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Five appends, merged, one of them appended again: each row once, from the merged files."""
    path, rows = scratch_path(spark, "small-files"), curated(spark, sf).drop("event_date")
    for i in range(5):
        C.write_curated(rows.where(F.pmod(F.xxhash64("insert_id"), F.lit(5)) == i), path, "append")
    compact(spark, path, most_files=1)
    append_once(rows.where(F.pmod(F.xxhash64("insert_id"), F.lit(5)) == 0), path)
    vacuum(spark, path)
    table = C.read_curated(spark, path)
    return table.groupBy(F.col("event_date").cast("string").alias("event_date"), "interaction_type").agg(F.count("*").alias("n"), F.countDistinct("insert_id").alias("ids"))
