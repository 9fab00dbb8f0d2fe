"""Checks that run over curated or masked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import detectors as D
from promptlens.functions import metrics as M


def residual_pii_audit(curated: DataFrame, detectors: Sequence[D.Detector] = D.PATTERN_DETECTORS, text: str = "prompt_text_masked") -> DataFrame:
    """Rows per information type still found in masked text; empty when all is masked."""
    return (
        curated.select(F.explode(D.info_types(F.col(text), detectors)).alias("info_type"))
        .groupBy("info_type")
        .agg(F.count("*").alias("remaining"))
    )


def actor_bijection_audit(pairs: DataFrame) -> DataFrame:
    """(employee_email, anonymous_actor_hash) to distinct emails, hashes and collisions.

    Pairs are made distinct first, so an actor with very many rows costs one row per task.
    """
    emails_per_hash = (
        pairs.select("employee_email", "anonymous_actor_hash").distinct()
        .groupBy("anonymous_actor_hash").agg(F.count("*").alias("emails"))
    )
    return emails_per_hash.agg(
        F.coalesce(F.sum("emails"), F.lit(0)).alias("distinct_emails"),
        F.count("*").alias("distinct_hashes"),
        F.count_if(F.col("emails") > 1).alias("colliding_hashes"),
    )


def run_counters(curated: DataFrame) -> DataFrame:
    """Totals of a run: rows, actors, flagged, SSN and toxic prompts."""
    per_actor = curated.groupBy("anonymous_actor_hash").agg(
        F.count("*").alias("n"),
        F.count_if("dlp_detected").alias("flagged"),
        F.count_if("contains_ssn").alias("ssn"),
        F.count_if("is_toxic_combination").alias("toxic"),
    )
    zero = F.lit(0)
    return per_actor.agg(
        F.coalesce(F.sum("n"), zero).alias("total_rows"),
        F.count("*").alias("unique_actors"),
        F.coalesce(F.sum("flagged"), zero).alias("flagged_rows"),
        F.coalesce(F.sum("ssn"), zero).alias("ssn_rows"),
        F.coalesce(F.sum("toxic"), zero).alias("toxic_rows"),
    )


def minutes_consistency_audit(curated: DataFrame) -> DataFrame:
    """Per complexity: rows, and rows whose minutes differ from the rubric's 5/15/45."""
    expected = M.manual_minutes(F.col("task_complexity"))
    return curated.groupBy("task_complexity").agg(
        F.count("*").alias("prompts"),
        F.count_if(~F.col("estimated_manual_minutes").eqNullSafe(expected)).alias("mismatches"),
    )
