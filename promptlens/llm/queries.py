"""The queries that apply each operator, with its production settings, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import chain, forest, grade, lattice, minhash, order, packing, repair, reshard, suffix, tokens, trie, wumanber
from promptlens.llm.conversation_sql import OP11_SQL, OP13_SQL
from promptlens.llm.sequence import digest, numbered
from promptlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict:
    """The byte-level vocabulary, and the same as ranks for the faster library."""
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ((tokens.END_OF_TEXT, 50256),)
    return {"path": vocabulary("byte_bpe_50k.json"), "ranks": ranks}


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-counts")  # a production cache stays from run to run
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), cache)


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **byte_level(), room=1024, end=2)


#: Words, windows and occurrences spelled out over lists; A-Z alone are lower-cased.
OP5_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, body)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
ORACLES["op5_benchmark_decontamination"] = OP5_SQL


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade.graded(docs, grade.train(docs, grade.label_grades(table(spark, sf_dir, "labels")), top=2))


@query
def op4_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by source, of very different sizes, to 8 of equal bytes."""
    docs, old = table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("source"), F.lit(12))
    plan, target = reshard.plan(docs, old, 12, 8), scratch_path(spark, "shards")
    untouched = reshard.rewrite(docs, plan, target)
    # what the new files hold, and the rows of the shards whose files stay
    written = spark.read.schema(docs.withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema).parquet(target)
    content = F.coalesce("text", F.lit(""))
    size, crc = F.octet_length(content) + F.lit(1).cast("long"), F.crc32(content)
    written = written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"), "shard", "slot")
    rows = written.unionByName(reshard.assigned(docs, plan, untouched)) if untouched else written
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "old_shard")


@query
def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.neighbours(table(spark, sf_dir, "embeddings"), lambda id: id % 20 == 0, top=20)


@query
def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sequence of every document lies in the written shards."""
    target = scratch_path(spark, "training-order")
    order.materialise(table(spark, sf_dir, "documents"), **byte_level(), target=target, key=20_261, end=50_256, pad=50_256)
    return order.manifest(spark, target, 2 * 1024).withColumnRenamed("id", "doc_id")


@query
def op9_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.shared_passages(table(spark, sf_dir, "documents"))


def rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The conversations with their first turns replaced by another's: turns (conv, d, digest, bytes), and (conv, n).

    Turns follow by turn, nulls first, and where turns tie by the digest of role and text; rows without conv_id
    take no part.
    """
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = trie._kept(numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("digest")]), "turns")
    base, h = F.col("conv") - F.col("conv") % 5, F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    each = rows.where("pos = 1").select("conv", "total", base.alias("base"), h.alias("h"))
    sizes = each.select(F.col("conv").alias("base"), F.col("total").alias("held"))
    each = each.join(sizes, "base", "left").withColumn("m", F.least("h", F.coalesce("held", F.lit(0))))
    each = trie._kept(each.withColumn("n", F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "conversations")
    heads = rows.where("pos <= 8").withColumnRenamed("conv", "base").join(each.select("base", "conv", "m"), "base").where("pos <= m")
    tails = rows.join(each.select("conv", "h", "m"), "conv").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    names = ["conv", F.col("pos").alias("d"), "digest", "bytes"]
    return heads.select(names).unionByName(tails.select(names)), each.select("conv", "n")


ORACLES["op11_prefix_trie"] = OP11_SQL


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*rebuilt(spark, sf_dir)).drop("name")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows lost, emptied, cut, said twice or in the wrong role, as a hash of conv_id and turn says.

    Nulls count as one space, in the hash too; the copy of a row follows it at once.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("harm"))
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where(harm != 0).select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


@query
def op12_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLES["op13_structure_repair"] = OP13_SQL


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    audits, repaired = repair.repair(damaged(rows))
    k = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k")
    out = rows.select("conv_id", k).distinct().join(audits, "k", "left").join(repair.fingerprints(repaired), "k", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
