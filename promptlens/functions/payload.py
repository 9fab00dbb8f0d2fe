"""Column helpers that turn loosely typed payload fields into curated values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlens import fixed_values as V


def field_or(col: Column, default: str) -> Column:
    """The field, or ``default`` where it is absent or null."""
    return F.coalesce(col, F.lit(default))


def field_or_null(col: Column, default: str) -> Column:
    """A variant field's text; ``default`` where it is absent, null where null is present."""
    text = F.coalesce(F.try_variant_get(col, "$", "string"), F.to_json(col))
    return F.when(col.isNull(), F.lit(default)).when(~F.is_variant_null(col), text)


def connectors_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def chat_path(connectors: Column) -> Column:
    """Path text of a chat row; with no connectors only the prefix remains."""
    return F.concat(F.lit(V.CHAT_PATH_PREFIX), F.array_join(connectors, V.CONNECTOR_SEPARATOR))


def agent_path(raw: Column) -> Column:
    """Path text of an agent row from the raw JSON of the field.

    A JSON list is joined; anything else keeps its own text; absent gives ''.
    """
    hops = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    return F.coalesce(F.array_join(hops, V.PATH_SEPARATOR), raw, F.lit(""))


def last_segment(col: Column) -> Column:
    """Text after the last '/', or the whole text; absent gives ''."""
    return F.substring_index(F.coalesce(col, F.lit("")), "/", -1)


def restamp_trace(col: Column, project: str) -> Column:
    return F.concat(F.lit(f"projects/{project}/traces/"), last_segment(col))


def insert_id_or_event_id(insert_id: Column, event_id: Column) -> Column:
    return F.coalesce(F.nullif(insert_id, F.lit("")), event_id)


def to_int(col: Column) -> Column:
    """Whole number of a JSON value: numbers are cut toward zero, texts must be whole numbers.

    Absent and null give 0; anything else gives null, which marks the row for rejection.
    """
    absent = col.isNull() | F.is_variant_null(col)
    return F.when(absent, F.lit(0).cast("bigint")).otherwise(F.try_variant_get(col, "$", "bigint"))


def parse_event_time(col: Column) -> Column:
    """ISO-8601 text with 'Z' or an offset to an instant; null where it does not parse."""
    return F.try_to_timestamp(col)


def default_severity(col: Column) -> Column:
    return F.coalesce(col, F.lit("INFO"))


def derive_severity(dlp_detected: Column) -> Column:
    return F.when(dlp_detected, F.lit("WARNING")).otherwise(F.lit("INFO"))


def title(col: Column) -> Column:
    """Each word with a capital first letter, the rest in lower case; words are cut at spaces."""
    return F.initcap(col)


def capitalize(col: Column) -> Column:
    """The first letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(col.substr(F.lit(2), F.length(col))))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"[^ \t\r\n\f]+"))


def extract_entity(text: Column) -> Column:
    """Line, fault code and lot named in a text: 'Line 3 (ERR-PLC-409) / Lot #402'."""
    line = F.nullif(F.regexp_extract(text, r"Line [0-9]+", 0), F.lit(""))
    fault = F.nullif(F.regexp_extract(text, r"ERR-[A-Z]+-[0-9]+", 0), F.lit(""))
    lot = F.nullif(F.regexp_extract(text, r"Lot #[0-9]+", 0), F.lit(""))
    place = F.nullif(
        F.concat_ws(" ", line, F.concat(F.lit("("), fault, F.lit(")"))), F.lit("")
    )
    return F.concat_ws(" / ", place, lot)
