"""SQL names for the scalar functions, so that reports can be written as SQL text.

Rates in SQL text use the built-in ``try_divide`` and ``count_if``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "is_toxic(types ARRAY<STRING>) RETURNS BOOLEAN": """
        array_contains(types, 'US_SOCIAL_SECURITY_NUMBER') AND arrays_overlap(
            types, array('MEDICAL_TERM', 'FINANCIAL_ACCOUNT_NUMBER', 'US_BANK_ROUTING_MICR'))""",
    "score_dlp_risk(types ARRAY<STRING>) RETURNS STRING": """CASE
        WHEN size(types) = 0 THEN 'NONE'
        WHEN is_toxic(types) THEN 'CRITICAL'
        WHEN arrays_overlap(types, array('US_SOCIAL_SECURITY_NUMBER', 'MEDICAL_TERM',
            'FINANCIAL_ACCOUNT_NUMBER', 'US_BANK_ROUTING_MICR')) THEN 'HIGH'
        WHEN array_contains(types, 'DATE_OF_BIRTH') THEN 'MEDIUM'
        ELSE 'LOW' END""",
    "format_dlp_actor_hash(digest STRING) RETURNS STRING": """CASE
        WHEN coalesce(digest, '') = '' THEN 'usr_anonymous'
        ELSE 'usr_' || substring(coalesce(
            lower(hex(try_to_binary(CASE WHEN length(regexp_replace(digest, '[^0-9A-Za-z+/=]', '')) % 4 = 0
                THEN regexp_replace(digest, '[^0-9A-Za-z+/=]', '') END, 'base64'))),
            lower(regexp_replace(digest, '[^0-9A-Za-z]', ''))), 1, 8) END""",
}


def register(spark: SparkSession) -> None:
    """Create the functions for the session; they are inlined into the plan."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_table(spark: SparkSession, path: str, name: str = "prompt_logs") -> None:
    """The curated table under a SQL name."""
    spark.read.parquet(path).createOrReplaceTempView(name)
