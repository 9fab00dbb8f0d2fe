"""Every operator and stage on odd rows, on no rows, and with other columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from promptlens.llm import chain, forest, grade, minhash, order, packing, queries, reshard, suffix, tokens, wumanber
from promptlens.session import scratch_path


@pytest.fixture(scope="session")
def items(spark):
    rows = [(1, "word0 other0 word1 other1 word2 other2 word3 other3 word4 other4 word5"), (2, None), (3, ""), (4, "word"), (None, "tail"), (4, "word")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("words", F.lit("clash"))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 1), (7, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")


def operators(spark, items, labels):
    byte_level = queries.byte_level()
    return {
        "suffix": lambda d: suffix.remove_repeats(d),
        "suffix_text": lambda d: suffix.remove_repeats(d, keep_text=True),
        "tokens": lambda d: tokens.count_tokens(d, queries.vocabulary("piece_bpe_32k.model"), scratch_path(spark, "cache")),
        "grade": lambda d: grade.graded(d, grade.train(d, grade.label_grades(labels), top=2)),
        "reshard": lambda d: reshard.reshard(d, F.pmod(F.hash("source"), F.lit(3)), 3, 2),
        "wumanber": lambda d: wumanber.contamination(d, items),
        "order": lambda d: materialised(spark, d, byte_level),
        "minhash": lambda d: minhash.near_duplicates(d),
        "chain": lambda d: chain.shared_passages(d),
        "packing": lambda d: packing.pack(d, **byte_level, end=2),
    }


def materialised(spark, docs, byte_level):
    target = scratch_path(spark, "order")
    order.materialise(docs, **byte_level, target=target, key=5, end=50_256)
    return order.manifest(spark, target, 2048)


NAMES = ["suffix", "suffix_text", "tokens", "grade", "reshard", "wumanber", "order", "minhash", "chain", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, documents, items, labels, name):
    rows = operators(spark, items, labels)[name](documents).collect()
    if name in ("order", "packing"):
        assert len({(r[0], r["piece"]) for r in rows}) >= 14
    elif name != "chain":
        assert len(rows) == documents.count()


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, nothing, items, labels, name):
    assert operators(spark, items, labels)[name](nothing).collect() == []


def test_stages_keep_columns_and_clean_rows(spark, documents, nothing, sf):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, nothing.select(names), sf).columns == names
        out = stage(spark, documents.select(names), sf)
        assert out.columns == names and out.count() > 3
    assert P.packed(spark, documents.select(names), sf).count() >= 15


def test_defined_results_for_odd_rows(spark, documents, items):
    dup = {r.doc_id: r for r in minhash.near_duplicates(documents).collect()}
    assert dup[2].component_id == 1 and not dup[2].kept and dup[9].component_id == 8
    assert (dup[4].n_shingles, dup[5].n_shingles, dup[12].n_shingles, dup[6].n_shingles) == (0, 0, 0, 1)
    assert dup[7].component_id == 6 and dup[4].kept and dup[5].kept and dup[None].kept and dup[None].component_id is None
    left = {r.doc_id: r for r in suffix.remove_repeats(documents).collect()}
    assert left[2].n_removed == left[2].n_bytes and left[1].n_removed < left[1].n_bytes
    assert (left[9].n_removed, left[10].n_removed, left[5].n_bytes) == (602, 4999, 0)
    hit = {r.doc_id: r for r in wumanber.contamination(documents, items).collect()}
    assert hit[6].n_items == 1 and hit[6].n_hit == 1 and hit[11].n_hit == 1 and hit[11].n_items == 0
    assert hit[1].n_items == 1 and hit[1].n_hit >= 11 and not hit[4].contaminated


def test_forest_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (20, [1.0, 1.0]), (8, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("data", F.lit(1))
    out = forest.neighbours(table, lambda id: id % 20 == 0, top=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 2, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    assert forest.neighbours(table.limit(0), lambda id: id % 20 == 0).collect() == []
