"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``
(the last: placed pieces). ``run`` writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import grade, minhash, packing, suffix, wumanber
from promptlens.llm.queries import byte_level, table
from promptlens.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rates good: others go.

    A text without words is judged by the thresholds alone; without labels all stay as likely as not, so good.
    """
    model = grade.train(docs, grade.label_grades(table(spark, sf_dir, "labels")), top=2)
    return grade.select_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group whose sets of five-word shingles are 80 percent alike.

    Texts without words, and rows without id, stay.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier; a document of which nothing stays goes."""
    out = suffix.remove_repeats(docs, keep_text=True)
    out = out.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.col("kept"))
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast("long")
    given = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": size.alias("n_chars")}
    return out.select(*(given.get(c, F.col(f"rest.`{c}`")) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words in a row of a benchmark item occur."""
    return wumanber.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, **byte_level(), room=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
