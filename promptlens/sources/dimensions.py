"""Dimensions: employee roster and agent catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptlens import fixed_values as V
from promptlens.schema import ROSTER


def read_roster(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Employees from JSON arrays (one file each) or, with ``multi_line=False``, JSON lines."""
    return spark.read.schema(ROSTER).option("multiLine", multi_line).json(path)


def tree_path(number: int) -> list[str]:
    """Hops from the router to an agent."""
    rows = {a[0]: a for a in V.AGENTS}
    parent = rows[number][5]
    return (tree_path(parent) if parent else [V.ROUTER]) + [rows[number][1]]


def agent_catalog(spark: SparkSession) -> DataFrame:
    """Ten agents with their path from the router; fixed size, safe to broadcast."""
    return spark.createDataFrame(
        [(n, agent, name, pillar, engine, tree_path(n)) for n, agent, name, pillar, engine, _ in V.AGENTS],
        "agent_num int, id string, name string, pillar string, reasoning_engine_id string, "
        "tree_path array<string>",
    )
