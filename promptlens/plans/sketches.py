"""Daily sketches beside the table: distinct actors and percentiles of any span of days without reading its rows.

A day's row holds mergeable sketches per unit or agent. Sketches of days are unioned for a span; a day that is loaded
again replaces its own. Exact reports over the rows stay the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.plans.reports import PERFORMANCE

#: Base-2 logarithm of a distinct sketch's slots: relative standard error of unions about 1.04 / 2 ** (LG / 2), 0.8 %.
LG = 14
#: Accuracy of quantile sketches: normalised rank error about 1.65 % at 200, less with more.
K = 400


def actor_sketches(curated: DataFrame, unit: str = "department") -> DataFrame:
    """(event_date, unit, prompts, actors): a distinct sketch of actors for each day and unit."""
    day = F.to_date("event_timestamp").alias("event_date")
    return curated.groupBy(day, F.col(unit).alias("unit")).agg(F.count("*").alias("prompts"), F.hll_sketch_agg("anonymous_actor_hash", LG).alias("actors"))


def distinct_actors(sketches: DataFrame, by: Sequence[str] = ("unit",)) -> DataFrame:
    """Distinct actors, about, per unit (or of all with ``by=()``) over the given days."""
    rows = sketches.groupBy(*by).agg(F.sum("prompts").alias("prompts"), F.hll_sketch_estimate(F.hll_union_agg("actors", False)).alias("actors"))
    return rows


def performance_sketches(curated: DataFrame) -> DataFrame:
    """(event_date, interaction_type, leaf_agent, metric, n, total, most, sketch): quantile sketches of each day."""
    long = curated.select(
        F.to_date("event_timestamp").alias("event_date"), "interaction_type", "leaf_agent",
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("v")) for m in PERFORMANCE))),
    ).where("v is not null")
    return long.groupBy("event_date", "interaction_type", "leaf_agent", "metric").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"), F.kll_sketch_agg_bigint("v", K).alias("sketch")
    )


def performance_of(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Mean, maximum and quantiles, about, per type, agent and metric over the given days."""
    keys = ["interaction_type", "leaf_agent", "metric"]
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("prompts"), F.round(F.sum("total") / F.sum("n"), 2).alias("mean"), F.max("most").alias("max"), F.kll_merge_agg_bigint("sketch", K).alias("sketch")
    )
    return merged.select(*keys, "prompts", "mean", "max", *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store days' sketches; days that are there already are replaced, others stay."""
    writer = sketches.repartition("event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date").parquet(path)
