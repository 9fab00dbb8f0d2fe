"""Prompt classification: the rule judge, a hook for external judges, validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens import fixed_values as V
from promptlens.functions import metrics as M
from promptlens.functions import rubric as R
from promptlens.operators.runs import Runs
from promptlens.schema import COACHING, GROUNDING, JUDGE, MATURITY
from promptlens.session import scratch_path

# The only columns a judge may see: all of them are de-identified.
JUDGE_INPUT = [
    "department", "interaction_type", "leaf_agent", "connectors_queried", "dlp_info_types",
    "prompt_text_masked",
]


def render_judge_input() -> Column:
    """The six-line text a judge reads; empty lists print 'None'."""

    def listed(name: str) -> Column:
        return F.when(F.size(name) > 0, F.array_join(name, ", ")).otherwise("None")

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Department: "), F.col("department")),
        F.concat(F.lit("Interaction Mode: "), F.col("interaction_type")),
        F.concat(F.lit("Invoked Agent: "), F.col("leaf_agent")),
        F.concat(F.lit("Connectors Queried: "), listed("connectors_queried")),
        F.concat(F.lit("DLP InfoTypes Detected & Masked: "), listed("dlp_info_types")),
        F.concat(F.lit("DLP-Masked Prompt Text:\n"), F.col("prompt_text_masked")),
    )


def rule_judge(df: DataFrame) -> DataFrame:
    """Add the judge columns by rules, all in narrow native expressions.

    The steps are stacked so that each text pattern is evaluated once per row.
    """
    text, low, c = F.col("prompt_text_masked"), F.col("_low"), F.col
    df = df.withColumn("_low", F.lower(text))
    df = df.withColumns(
        {
            "_verb": R.first_verb(low),
            "_short": R.is_short(text),
            "_search": R.is_search_query_style(text),
            "_persona": R.has_persona(low),
            "_format": R.has_explicit_format(low),
            "_limits": R.has_constraints(low),
            "_grounding": R.grounding_type(low, c("connectors_queried"), c("leaf_agent")),
            "_requires": R.requires_enterprise_knowledge(low, c("connectors_queried")),
            "_pii": R.needs_minimisation(text),
        }
    )
    df = df.withColumn("functional_intent", R.functional_intent(c("_verb")))
    df = df.withColumns(
        {
            "_level": R.maturity_level(c("_short"), c("_persona"), c("_format"), c("_limits")),
            "_corpus": R.target_corpus(
                c("functional_intent"), c("connectors_queried"), c("leaf_agent"), c("department")
            ),
            "_gap": M.is_retrieval_gap(c("_requires"), c("_grounding")),
        }
    )
    df = df.withColumns(
        {
            "task_complexity": R.task_complexity(
                c("functional_intent"), low, c("connectors_queried"), c("_search")
            ),
            "_missing": R.missing_elements(
                c("_persona"), c("_format"), c("_limits"), c("_gap"), c("_pii")
            ),
            "_target": R.recommended_target(
                c("dlp_info_types"), c("leaf_agent"), c("connectors_queried"), c("_corpus")
            ),
        }
    )
    structs = {
        "specification_maturity": (MATURITY, ["_level", "_persona", "_format", "_limits", "_search"]),
        "grounding_analysis": (GROUNDING, ["_grounding", "_requires", "_corpus"]),
    }
    nested = {
        name: F.struct(*(c(col).alias(f.name) for col, f in zip(cols, schema.fields)))
        for name, (schema, cols) in structs.items()
    }
    coaching = [
        R.needs_improvement(c("_level"), c("_gap"), c("_pii")),
        c("_missing"),
        R.recommendation(c("_missing")),
        R.rewritten_prompt(
            R.without_masked_values(text, c("_pii")), c("department"), c("_missing"), c("_target")
        ),
        c("_target"),
    ]
    nested["prompt_coaching"] = F.struct(
        *(col.alias(f.name) for col, f in zip(coaching, COACHING.fields))
    )
    nested["estimated_manual_minutes"] = M.manual_minutes(c("task_complexity"))
    temporary = [
        "_low", "_verb", "_short", "_persona", "_format", "_limits", "_grounding", "_requires", "_pii",
        "_search", "_level", "_corpus", "_gap", "_missing", "_target",
    ]
    return df.withColumns(nested).drop(*temporary)


def judge_with(df: DataFrame, client_factory: Callable[[], Callable[[list[str]], list[str]]], batch_rows: int = V.CHUNK_ROWS, parallelism: int | None = None) -> DataFrame:
    """Add ``judge_json`` from an external judge.

    ``client_factory`` runs once per partition and returns a callable that maps at
    most ``batch_rows`` rendered inputs to JSON answers. Only the rendered masked
    text crosses to Python; all other columns stay in the JVM, so no join is needed.
    ``parallelism`` caps the number of concurrent clients.
    """

    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = client_factory()
        for batch in batches:
            texts = batch.tolist()
            answers: list[str] = []
            for start in range(0, len(texts), batch_rows):
                answers += client(texts[start : start + batch_rows])
            yield pd.Series(answers, dtype="object")

    # real types, not postponed text: pandas_udf reads them to pick the iterator form
    ask.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    judge = F.pandas_udf(ask, "string")
    if parallelism:
        df = df.repartition(parallelism)
    return df.withColumn("judge_json", judge(render_judge_input()))


def is_valid_judgement(j: Column) -> Column:
    """All enumerations, types and nested fields are present and valid."""
    maturity, grounding, coaching = (
        j["specification_maturity"], j["grounding_analysis"], j["prompt_coaching"],
    )
    flags = [maturity[f.name] for f in MATURITY.fields[1:]]
    required = flags + [
        grounding["requires_enterprise_knowledge"], j["estimated_manual_minutes"],
        coaching["needs_improvement"], coaching["missing_elements"],
        coaching["improvement_recommendation"], coaching["rewritten_level_3_prompt"],
        coaching["recommended_target_agent_or_connector"],
    ]
    tests = [
        j["functional_intent"].isin(*V.INTENTS),
        j["task_complexity"].isin(*V.COMPLEXITIES),
        maturity["level"].isin(*V.LEVELS),
        grounding["grounding_type"].isin(*V.GROUNDINGS),
        grounding["target_corpus"].isin(*V.CORPORA),
        F.forall(coaching["missing_elements"], lambda e: e.isin(*V.MISSING_ELEMENTS)),
        j["estimated_manual_minutes"] == F.floor(j["estimated_manual_minutes"]),
    ] + [r.isNotNull() for r in required]
    valid = j.isNotNull()
    for test in tests:
        valid = valid & F.coalesce(test, F.lit(False))
    return valid


# minutes may come as 5.0: whole numbers are told by their value
_ANSWER = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == "estimated_manual_minutes" else f.dataType) for f in JUDGE.fields])


def parse_judgement(df: DataFrame, column: str = "judge_json") -> DataFrame:
    """Judge JSON to the judge columns plus ``judge_valid``; the JSON is dropped.

    The answer passes through a generator: later filters then use the parsed value
    instead of parsing once per test.
    """
    answer = F.from_json(column, _ANSWER).alias("_j")
    parsed = df.select("*", F.inline(F.array(F.struct(answer)))).withColumn(
        "judge_valid", is_valid_judgement(F.col("_j"))
    )
    columns = {f.name: F.col("_j")[f.name].cast(f.dataType) for f in JUDGE.fields}
    return parsed.withColumns(columns).drop("_j", column)


def store_judgements(judged: DataFrame, path: str) -> DataFrame:
    """Write judged rows and read them back.

    Valid rows and rejects are two reads of one frame; without this step each of them
    would call the external judge again.
    """
    judged.write.mode("overwrite").parquet(path)
    return judged.sparkSession.read.parquet(path)


def validate_judge(df: DataFrame, column: str = "judge_json") -> tuple[DataFrame, DataFrame]:
    """Split judged rows into valid ones (judge columns added) and rejects (id and reason).

    Where both are used, store the judged rows first (:func:`store_judgements`).
    """
    parsed = parse_judgement(df, column)
    good = parsed.where("judge_valid").drop("judge_valid")
    bad = parsed.where(~F.col("judge_valid")).select(
        "insert_id", F.lit("invalid judgement").alias("reason")
    )
    return good, bad


ANSWERS = "judge_digest string, attempt int, judge_valid boolean, judge_json string"


def answers_at(spark: SparkSession, path: str) -> Runs:
    """The store of a judge's answers under a path, by digest of what it was asked."""
    return Runs(spark, path, "judge_digest", ANSWERS)


def judge_stored(rows: DataFrame, client_factory: Callable[[], Callable[[list[str]], list[str]]], store: Runs, attempts: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """(judged rows, rejects) of masked rows, by an external judge whose answers are kept.

    Each distinct input is asked once, however many rows hold it and however often a load is repeated: an answer
    in the store is used. An answer that isn't valid is asked again, up to ``attempts`` times over all loads; then its rows are
    rejects (event_id where there is one, insert_id, reason). Answers are stored attempt by attempt, before any row is
    written, so a failure loses one attempt's answers at most.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "to-judge")
    rows.withColumn("judge_digest", F.sha2(render_judge_input(), 256)).write.parquet(path)
    rows = spark.read.parquet(path)
    count = rows.count()
    known = store.having(rows, count)
    pending = rows.select("judge_digest", *JUDGE_INPUT).dropDuplicates(["judge_digest"])
    if known is None:
        pending = pending.withColumn("attempt", F.lit(0))
    else:
        tried = known.groupBy("judge_digest").agg(F.max("attempt").alias("attempt"), F.max("judge_valid").alias("judge_valid"))
        pending = pending.join(tried, "judge_digest", "left").where("not coalesce(judge_valid, false)")
        pending = pending.withColumn("attempt", F.coalesce("attempt", F.lit(0))).drop("judge_valid")
    for _ in range(attempts):
        pending = pending.where(F.col("attempt") < attempts)
        asked = judge_with(pending.withColumn("attempt", F.col("attempt") + 1), client_factory, **options)
        valid = parse_judgement(asked.withColumn("_json", F.col("judge_json")), "_json").select("judge_digest", "attempt", "judge_valid", "judge_json")
        run = store.write(valid, count)
        again = store.read(run).where("not judge_valid")
        store.mark(run)
        if again.where(F.col("attempt") < attempts).isEmpty():
            break
        pending = rows.select("judge_digest", *JUDGE_INPUT).dropDuplicates(["judge_digest"]).join(again.select("judge_digest", "attempt"), "judge_digest")
    store.compact()
    every = store.having(rows, count)
    best = every.groupBy("judge_digest").agg(F.max("attempt").alias("attempt"), F.min_by("judge_json", F.when(F.col("judge_valid"), F.col("attempt"))).alias("judge_json"))
    judged = rows.join(best, "judge_digest")
    good = parse_judgement(judged.where("judge_json is not null")).drop("judge_valid", "judge_digest", "attempt")
    event = F.col("event_id") if "event_id" in rows.columns else F.lit(None).cast("string").alias("event_id")
    reason = F.concat(F.lit("invalid judgement after "), F.col("attempt").cast("string"), F.lit(" attempts")).alias("reason")
    return good, judged.where("judge_json is null").select(event, "insert_id", reason)
