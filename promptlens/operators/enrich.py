"""Lookups: roster and catalog attributes, orphans, rows already loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions.hashing import DIGITS, ActorKey, actor_hash, email_digest
from promptlens.operators.normalize import IDENTITY


def enrich_agent(df: DataFrame, catalog: DataFrame, on: str = "agent_num") -> DataFrame:
    """Agent number to id, pillar and path. Small catalogs are broadcast by their measured size."""
    return df.join(catalog.withColumnRenamed("agent_num", on), on, "left")


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """The rows, failing on a key that occurs twice: in a lookup it would multiply rows."""
    columns = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in columns))
    twice = F.raise_error(F.concat(F.lit(f"{key} twice in the roster: "), F.coalesce(key, F.lit("null")))).cast("string")
    return one.select(F.when(F.col("n") == 1, F.col(key)).otherwise(twice).alias(key), *columns)


def enrich_employee(df: DataFrame, roster: DataFrame, key: ActorKey, digits: int = DIGITS) -> DataFrame:
    """Employee attributes by ``employee_id``, for rosters and tables of any size.

    The join may move rows, so nothing raw takes part, whatever the size: ids on both sides, names and
    emails of the roster become keyed digests first, and a frame with raw columns is refused (mask it
    first). Rows and roster lines without id meet nobody; ``digits`` is the length of actor ids. Gives ``employee_key``, ``anonymous_actor_hash``, ``department``, ``employee_role``, ``plant_location``, ``shift``.
    """
    raw = [c for c in IDENTITY if c in df.columns]
    if raw:
        raise ValueError(f"de-identify {raw} first: a join moves rows between executors")
    attributes = {"role": "employee_role", "department": "department", "plant_location": "plant_location", "shift": "shift"}
    no_id = F.lit("")
    hidden = roster.select(
        F.nullif(email_digest(F.col("employee_id"), key), no_id).alias("employee_key"), actor_hash(F.col("employee_email"), key, digits).alias("anonymous_actor_hash"),
        *(F.col(c).alias(name) for c, name in attributes.items()),
    )
    hidden = unique_by(hidden.where("employee_key is not null"), "employee_key")
    rows = df.withColumn("employee_key", F.nullif(email_digest(F.col("employee_id"), key), no_id)).drop("employee_id", *hidden.columns[1:])
    return rows.join(hidden, "employee_key", "left")


def pillar_of(kind: Column, department: Column, agent_pillar: Column) -> Column:
    """Chat belongs to the sender's department, agent work to the agent's pillar."""
    return F.when(kind == V.CHAT, department).otherwise(agent_pillar)


def lookup_multiplier(df: DataFrame, table: DataFrame, level: str = "level") -> DataFrame:
    """Configurable multipliers (level, maturity_multiplier), a handful of rows;
    unknown levels get the default."""
    joined = df.join(table.withColumnRenamed("level", level), level, "left")
    return joined.withColumn(
        "maturity_multiplier", F.coalesce("maturity_multiplier", F.lit(V.DEFAULT_MULTIPLIER))
    )


def orphan_agents(curated: DataFrame, catalog: DataFrame) -> DataFrame:
    """Leaf agents that the catalog does not know, with their volume."""
    seen = curated.where(F.col("interaction_type") != V.CHAT).groupBy("leaf_agent").agg(
        F.count("*").alias("prompts")
    )
    known = catalog.select(F.col("id").alias("leaf_agent"))
    return seen.join(known, "leaf_agent", "left_anti")


def already_loaded(new: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows whose id is not among the loaded ones, a table or the buckets of its ledger; only its id column is read."""
    return new.join(loaded.select("insert_id"), "insert_id", "left_anti")
