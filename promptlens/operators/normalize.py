"""Log entries of both shapes to one flat frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from promptlens import fixed_values as V
from promptlens.functions import payload as P

IDENTITY = ["employee_name", "employee_email", "prompt_text"]


def interaction_type(payload: Column) -> Column:
    """Entries without a type are agent executions."""
    return P.field_or(payload["interaction_type"], V.AGENT)


def project_chat(native: Column, field: Column) -> Column:
    """Chat rows carry the native-chat marker as agent; other rows their own field or ''."""
    return F.when(native, V.NATIVE_CHAT_AGENT).otherwise(P.field_or(field, ""))


def flatten(entries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(event_id, entry) to flat columns, and those to ``keep`` as they are. Raw identity and prompt are still present;
    :func:`promptlens.operators.deidentify.deidentify` must follow before any shuffle. Absent and null fields both get their
    default; of strictly parsed entries department, role, plant, shift and pillar keep a present null."""
    e, p = F.col("entry"), F.col("entry.jsonPayload")
    connectors = P.connectors_or_empty(p["connectors_queried"])
    kind = interaction_type(p)
    native = kind == V.CHAT
    strict = isinstance(entries.schema["entry"].dataType["jsonPayload"].dataType["department"].dataType, VariantType)
    text_or = P.field_or_null if strict else P.field_or
    columns = {
        "insert_id": P.insert_id_or_event_id(e["insertId"], F.col("event_id")),
        "event_timestamp": P.parse_event_time(e["timestamp"]),
        "interaction_type": kind,
        "trace_id": P.last_segment(e["trace"]),
        "span_id": P.field_or(e["spanId"], ""),
        "department": text_or(p["department"], "Unknown"),
        "employee_role": text_or(p["employee_role"], "Unknown"),
        "plant_location": text_or(p["plant_location"], "Unknown"),
        "shift": text_or(p["shift"], "Unknown"),
        "pillar": text_or(p["pillar"], "Unknown"),
        "root_agent": project_chat(native, p["root_agent"]),
        "leaf_agent": project_chat(native, p["leaf_agent"]),
        "agent_tree_path": F.when(native, P.chat_path(connectors)).otherwise(
            P.agent_path(p["agent_tree_path"])
        ),
        "connectors_queried": connectors,
        "operational_entity": P.field_or(p["operational_entity"], ""),
        "topic_cluster": P.field_or(p["topic_cluster"], ""),
        "latency_ms": P.to_int(p["latency_ms"]),
        "prompt_tokens": P.to_int(p["prompt_tokens"]),
        "response_tokens": P.to_int(p["response_tokens"]),
        "employee_name": P.field_or(p["employee_name"], ""),
        "employee_email": P.field_or(p["employee_email"], ""),
        "prompt_text": P.field_or(p["prompt_text"], ""),
    }
    return entries.select(*keep, *(c.alias(name) for name, c in columns.items()))
