"""Test telemetry: raw log entries derived from an ``events`` table by narrow arithmetic.

A bottling company. Every event becomes one entry whose prompt is put together from independent
parts (a task, a clause with personal data, a style), each picked by arithmetic of its own, so
that all combinations occur. ``telemetry_sql`` writes the same rule down for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions import payload as P
from promptlens.sources.dimensions import tree_path

PROJECT = "demo"
DEPARTMENTS = ["Operations", "Finance", "HR"]
SITES = ["Aldermoor", "Brackwater", "Cinderford", "Dunholme", "Eastwick"]
ROLES = ["Team member", "Team lead", "Specialist", "Manager"]
# name, email, ssn, dob, account, routing: invented, in non-issuable ranges
SUBJECTS = [
    ("Alma Reyes", "alma.reyes@bottler.example", "000-11-1001", "01/02/1981", "1000200030", "100000001"),
    ("Boris Lindqvist", "boris.l@bottler.example", "000-12-1002", "02/03/1982", "1000200031", "100000002"),
    ("Chidi Okafor", "chidi.o@agency.example", "000-13-1003", "03/04/1983", "1000200032", "100000003"),
    ("Dana Whitlock", "dana.w@bottler.example", "000-14-1004", "04/05/1984", "1000200033", "100000004"),
    ("Emil Hartmann", "emil.h@agency.example", "000-15-1005", "05/06/1985", "1000200034", "100000005"),
    ("Farah Siddiqui", "farah.s@bottler.example", "000-16-1006", "06/07/1986", "1000200035", "100000006"),
    ("Gustavo Lima", "gustavo.lima@bottler.example", "000-17-1007", "07/08/1987", "1000200036", "100000007"),
]
SUBJECT_FIELDS = ["name", "email", "ssn", "dob", "acct", "routing"]
SUBJECT_NAMES = [s[0] for s in SUBJECTS]
INJURIES = ["a wrist sprain", "contact dermatitis", "a crush injury", "tinnitus", "a mild concussion"]

# (topic, entity, text)
TASKS = [
    ("Filler downtime", "{line} ({code})", "Why does the filler on {line} report {code} after every wash cycle in {site}?"),
    ("Cap torque", "{line}", "Compare cap torque readings of {line} in {site} before and after the spindle change."),
    ("Glass delivery", "{lot}", "Draft a complaint about chipped glass in {lot}, which arrived in {site} yesterday."),
    ("Label scanner", "{line} ({code})", "Debug the label scanner script that logs {code} whenever {line} restarts."),
    ("Syrup yield", "{line} / {lot}", "Calculate the syrup yield of {lot} on {line} and show the loss per pallet."),
    ("Energy budget", "{line}", "Forecast the energy budget of {line} in {site} for the coming winter."),
    ("Night work", "{line}", "What allowance do crews on {line} get for night work under the {shift} agreement?"),
    ("Recipe cards", "{line}", "Translate the recipe cards for {line} into Portuguese."),
    ("Pallet counts", "{line} / {lot}", "Extract the pallet counts of {lot} from the dispatch notes of {line}."),
    ("Cooling water", "{line} ({code})", "Write a checklist for the cooling water loop of {line} in case {code} comes up again."),
    ("Training plan", "", "Prepare a training plan for new starters in {site}."),
]
# what is said about a person, with the personal data it holds
CLAUSES = [
    "",
    "Ask {name} ({email}) if anything is unclear.",
    "",
    "The person in charge is {name}, SSN: {ssn}.",
    "It is for {name}, born {dob}, {email}.",
    "Pay goes to {name}, SSN: {ssn}, Acct #{acct}, Routing #{routing}.",
    "{name} (SSN: {ssn}, {dob}) reported {injury} there.",
    "Supplier account: Acct #{acct}; ask {name}.",
    "{name} went home with {injury}.",
]
PLAIN, CRISP, SEARCH, LIMITED, PASTED = range(5)
SEARCH_TEXTS = ["filler valve cleaning steps", "glass price per supplier", "night work allowance rules"]
PASTED_TEXT = "Summarize the following rows: batch,fill,cap; 71,0.499,ok; 72,0.501,ok"
OPENING, FORMAT_LINE, LIMIT_LINE = "Act as a patient colleague. ", " Answer with bullet points.", " Do not go beyond last month."
CODES = ["ERR-PLC-409", "ERR-FIL-118", "ERR-CAP-207"]
LOTS = ["Lot #402", "Lot #517"]
# pairs of connectors, one apart by four places; the last place stands for none
CONNECTOR_SETS = [f"{V.CONNECTORS[i]},{V.CONNECTORS[(i + 4) % 15]}" if i % 3 else V.CONNECTORS[i] for i in range(15)] + [""]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def _div(col: Column, n: int) -> Column:
    return F.floor(col / n)


def _fill(template: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def facts(events: DataFrame) -> DataFrame:
    """Who, where, and which parts, per event."""
    eid, user = F.col("event_id"), F.col("user_id")
    return events.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "mode": F.when(eid % 3 == 0, V.CHAT).otherwise(V.AGENT),
            "department": _pick(DEPARTMENTS, user % 3),
            "plant": _pick(SITES, _div(user, 3) % 5),
            "shift": F.concat(F.lit("Shift "), (user % 2 + 1 + _div(user, 2) % 2).cast("string")),
            "role": _pick(ROLES, _div(user, 5) % 4),
            "line": F.concat(F.lit("Line "), (_div(eid, 2) % 5 + 1).cast("string")),
            "style": _div(eid, 11) % 5,
            "code": _pick(CODES, _div(eid, 4) % 3),
            "lot": _pick(LOTS, _div(eid, 6) % 2),
        }
    ).withColumn("agent_num", ((_div(eid, 3) + F.col("k")) % 10 + 1).cast("int"))


def prompts(events: DataFrame) -> DataFrame:
    """Facts plus prompt text, topic, entity and connectors."""
    f = facts(events)
    eid, style = F.col("event_id"), F.col("style")
    subject, task = _div(eid, 7) % len(SUBJECTS), (_div(eid, 4) + F.col("k")) % len(TASKS)
    fields = {name: _pick([s[i] for s in SUBJECTS], subject) for i, name in enumerate(SUBJECT_FIELDS)}
    fields |= {"site": F.col("plant"), **{name: F.col(name) for name in ("shift", "line", "code", "lot")}}
    fields["injury"] = _pick(INJURIES, _div(eid, 5) % len(INJURIES))
    clause = _fill(_pick(CLAUSES, _div(eid, 5) % len(CLAUSES)), fields)
    body = F.concat(_fill(_pick([t[2] for t in TASKS], task), fields), F.when(clause == "", "").otherwise(F.concat(F.lit(" "), clause)))
    text = (
        F.when(style == CRISP, F.concat(F.lit(OPENING), body, F.lit(FORMAT_LINE)))
        .when(style == SEARCH, _pick(SEARCH_TEXTS, F.col("user_id") % 3))
        .when(style == LIMITED, F.concat(body, F.lit(LIMIT_LINE)))
        .when(style == PASTED, PASTED_TEXT)
        .otherwise(body)
    )
    joined = _pick(CONNECTOR_SETS, _div(eid, 9) % 16)
    searched = (F.col("mode") == V.CHAT) & ~style.isin(SEARCH, PASTED) & (joined != "")
    return f.withColumns(
        {
            "prompt_text": text,
            "topic": _pick([t[0] for t in TASKS], task),
            "entity": _fill(_pick([t[1] for t in TASKS], task), fields),
            "connectors": F.when(searched, F.split(joined, ",")).otherwise(F.array().cast("array<string>")),
        }
    )


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def entry_struct(changes: dict[str, Callable[[Column], Column]] | None = None, ts: Column | None = None) -> Column:
    """The raw log entry; fields of the other shape are null and so absent from the JSON.

    ``changes`` maps payload fields to a change of their value, ``ts`` replaces the time.
    """
    eid, c = F.col("event_id"), F.col
    text_id = eid.cast("string")
    chat = c("mode") == V.CHAT
    trace = F.substring(F.md5(F.concat(F.lit("trace-"), text_id)), 1, 32)
    agent_ids = [a[1] for a in V.AGENTS]
    def agent_value(values: list) -> Column:
        index = c("agent_num")
        return F.when(~chat, F.element_at(F.array(*values), index))

    pillar = F.when(chat, c("department")).otherwise(
        F.element_at(F.array(*(F.lit(a[3]) for a in V.AGENTS)), c("agent_num"))
    )
    paths = [F.array(*(F.lit(h) for h in tree_path(a[0]))) for a in V.AGENTS]
    words = P.word_count(c("prompt_text"))
    payload = {
        "event_type": c("mode"),
        "interaction_type": c("mode"),
        "session_id": F.concat(F.lit("sess_"), F.substring(trace, 1, 12)),
        "employee_id": F.concat(F.lit("EMP-"), c("user_id").cast("string")),
        "employee_name": F.concat(F.lit("User "), c("user_id").cast("string")),
        "employee_email": F.concat(F.lit("user"), c("user_id").cast("string"), F.lit("@bottler.example")),
        "department": c("department"),
        "employee_role": c("role"),
        "plant_location": c("plant"),
        "shift": c("shift"),
        "pillar": pillar,
        "root_agent": agent_value([F.lit(tree_path(a[0])[1]) for a in V.AGENTS]),
        "leaf_agent": agent_value([F.lit(a) for a in agent_ids]),
        "agent_tree_path": agent_value(paths),
        "ge_app_id": F.when(chat, "bottler-search"),
        "connectors_queried": c("connectors"),
        "prompt_text": c("prompt_text"),
        "operational_entity": c("entity"),
        "topic_cluster": c("topic"),
        "latency_ms": 90 + eid * 37 % 4001,
        "prompt_tokens": words + words % 3 + eid % 17,
        "response_tokens": 40 + eid * 13 % 701,
    }
    for name, change in (changes or {}).items():
        payload[name] = change(payload[name])
    return F.struct(
        F.concat(F.lit("log-"), text_id).alias("insertId"),
        F.when(chat, V.CHAT_STREAM).otherwise(V.AGENT_STREAM).alias("logName"),
        F.date_format("ts" if ts is None else ts, ISO).alias("timestamp"),
        F.when(eid % 3 == 0, "NOTICE").alias("severity"),
        F.concat(F.lit(f"projects/{PROJECT}/traces/"), trace).alias("trace"),
        F.substring(F.md5(F.concat(F.lit("span-"), text_id)), 1, 16).alias("spanId"),
        F.struct(*(v.alias(k) for k, v in payload.items())).alias("jsonPayload"),
    )


def _rows(df: DataFrame, *columns: Column) -> DataFrame:
    """Select through a generator: later filters stay above it, so the derivation is
    neither repeated nor expanded inside them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def entry_json(events: DataFrame) -> DataFrame:
    """(event_id, mode, value): one JSON log entry per event."""
    return _rows(
        prompts(events), F.col("event_id"), F.col("mode"), F.to_json(entry_struct()).alias("value")
    )


def messages(events: DataFrame) -> DataFrame:
    """Message envelopes (event_id text, data base64)."""
    return _rows(
        prompts(events),
        F.concat(F.lit("msg-"), F.col("event_id").cast("string")).alias("event_id"),
        F.base64(F.to_json(entry_struct()).cast("binary")).alias("data"),
    )


def disturbed_messages(events: DataFrame) -> DataFrame:
    """Messages with deliveries a pipeline must survive: empty data, undecodable JSON, invalid
    UTF-8, null and absent fields, a scalar path, a numeric string, a fraction, a number that is
    none, a field of another type that nothing reads, and redeliveries, some of them good after bad."""
    eid, value = F.col("event_id"), F.col("value")
    changes = {
        "department": lambda c: F.when(eid % 211 != 0, c),
        "interaction_type": lambda c: F.when((eid % 223 != 0) | (c == V.CHAT), c),
    }
    rows = _rows(prompts(events), eid, F.to_json(entry_struct(changes)).alias("value"))
    spoiled = {
        227: F.regexp_replace(value, r'"agent_tree_path":\[[^\]]*\]', '"agent_tree_path":"direct call"'),
        229: F.regexp_replace(value, r'"latency_ms":[0-9]+', '"latency_ms":"12"'),
        233: F.regexp_replace(value, r'("latency_ms":[0-9]+)', "$1.7"),
        350: F.regexp_replace(value, r'"latency_ms":[^,}]+', '"latency_ms":"soon"'),
        239: F.concat(F.lit('{"resource":"global",'), F.substring(value, F.lit(2), F.length(value))),
        997: F.substring(value, 1, 40),
    }
    for every, change in spoiled.items():  # a step each: in one expression, every change would repeat all those before it
        rows = rows.withColumn("value", F.when(eid % every == 0, change).otherwise(value))
    first = _rows(
        rows,
        F.concat(F.lit("msg-"), eid.cast("string")).alias("event_id"),
        F.when(eid % 499 == 0, "")
        .when(eid % 241 == 0, F.base64(F.concat(F.unhex(F.lit("FF")), value.cast("binary"))))
        .otherwise(F.base64(value.cast("binary"))).alias("data"),
    )
    later = _rows(
        prompts(events.where(eid % 50 == 0)),
        F.concat(F.lit("again-"), eid.cast("string")).alias("event_id"),
        F.base64(F.to_json(entry_struct(ts=F.col("ts") + F.expr("interval 1 second"))).cast("binary")).alias("data"),
    )
    return first.unionByName(later)


def roster(events: DataFrame) -> DataFrame:
    """One employee row per user of the event table."""
    people = facts(events).select(
        F.concat(F.lit("EMP-"), F.col("user_id").cast("string")).alias("employee_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("employee_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@bottler.example")).alias("employee_email"),
        "department", "role", F.col("plant").alias("plant_location"), "shift",
    )
    return people.distinct()


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "props")
