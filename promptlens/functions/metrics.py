"""Return-on-effort and gap metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlens import fixed_values as V


def maturity_multiplier(level: Column) -> Column:
    """0.5 / 0.75 / 1.0 by level; unknown levels get 0.75."""
    expr = F.lit(V.DEFAULT_MULTIPLIER)
    for name, value in V.MATURITY_MULTIPLIERS.items():
        expr = F.when(level == name, F.lit(value)).otherwise(expr)
    return expr


def adjusted_minutes(minutes: Column, multiplier: Column) -> Column:
    return F.round(minutes * multiplier, 2)


def extra_minutes(minutes: Column, multiplier: Column) -> Column:
    return F.round(minutes * (F.lit(1.0) - multiplier), 2)


def is_retrieval_gap(requires: Column, grounding: Column) -> Column:
    return F.coalesce(requires & (grounding == V.GROUNDING_NONE), F.lit(False))


def manual_minutes(complexity: Column) -> Column:
    expr = F.lit(None).cast("bigint")
    for name, value in V.MANUAL_MINUTES.items():
        expr = F.when(complexity == name, F.lit(value).cast("bigint")).otherwise(expr)
    return expr


def level_index(level: Column) -> Column:
    """1.0 / 2.0 / 3.0 by level; unknown levels are null and so left out of a mean."""
    expr = F.lit(None).cast("double")
    for i, name in enumerate(V.LEVELS, 1):
        expr = F.when(level == name, F.lit(float(i))).otherwise(expr)
    return expr


def pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; null where the whole is zero."""
    return F.round(F.try_divide(part, whole) * 100, 1)


def hours(minutes: Column) -> Column:
    return F.round(F.sum(minutes) / 60.0, 1)
