"""Each registered query against a plain version, an exact round trip or held-out figures."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as P
from promptlens.llm import chain, forest, grade, graph, minhash, order, packing, queries, reshard, suffix, tokens, wumanber
from promptlens.session import scratch_path
from tests.llm import plain

Q = queries.QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=300, deadline=None)
def test_suffix_array_and_common_prefixes(symbols):
    text = np.array(symbols, dtype=np.int16)
    got = suffix.suffix_array(text)
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert got.tolist() == want
    shared = suffix.permuted_lcp(text, got)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        assert shared[b] == n


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(8)]
    docs = {d: "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for d in range(40)}
    docs[40] = "ab" * 200
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    for length, least in ((100, 24), (20, 6)):
        got = {r[0]: tuple(r)[1:] for r in suffix.remove_repeats(frame, length=length, seed=least).collect()}
        assert got == plain.left_of({d: t.encode() for d, t in docs.items()}, length)


def test_op1(spark, sf, texts):
    got = {r.doc_id: tuple(r)[1:] for r in Q["op1_suffix_array_dedup"](spark, sf).collect()}
    assert got == plain.left_of({d: (t or "").encode() for d, t in texts.items()})


def test_kept_text_loses_whole_characters_only(spark):
    rows = [(1, "xyz" * 11 + "é" * 200), (2, "é" * 60 + "end"), (3, "q" + "é" * 60)]
    out = {r.doc_id: r.kept for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    assert out[2] == "end" and out[3] == "q"


def test_op2_and_its_cache(spark, sf, texts):
    model = tokens._pieces(queries.vocabulary("piece_bpe_32k.model"))
    want = {d: len(model.encode(t or "")) for d, t in texts.items()}
    got = Q["op2_token_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 4096) for r in got)
    cache, path = scratch_path(spark, "cache"), queries.vocabulary("piece_bpe_32k.model")
    docs = queries.table(spark, sf, "documents")
    tokens.count_tokens(docs.where("doc_id < 50"), path, cache).collect()
    held = spark.read.parquet(cache).count()
    assert held == len({texts[d] for d in texts if d < 50})
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path, cache).collect()} == want
    assert spark.read.parquet(cache).count() == len(set(texts.values()))
    # what is stored is believed: nothing is encoded twice
    fake = scratch_path(spark, "cache")
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(fake)
    assert {r.n_tokens for r in tokens.count_tokens(docs, path, fake).collect()} == {7}


@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"]), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ranks_give_the_library_s_ids(several):
    several = [*several, "a <|endoftext|>\n\n b", *(" x" + chr(c) * 2 + "1 " + chr(c) for c in range(0, 0x250, 37))]
    byte_level = queries.byte_level()
    fast, slow = tokens.encode(several, **byte_level), tokens.encode(several, byte_level["path"])
    assert [x.tolist() for x in fast] == [x.tolist() for x in slow]


def test_ranks_on_every_character_they_are_used_for(texts):
    byte_level = queries.byte_level()
    each = [f"a{chr(c)}{chr(c)} {chr(c)}1{chr(c)}  {chr(c)}\n{chr(c)}!" for c in range(0x250)] + list(filter(None, texts.values()))
    fast, slow = tokens.encode(each, **byte_level), tokens.encode(each, byte_level["path"])
    assert all(np.array_equal(a, b) for a, b in zip(fast, slow))


def test_op3_on_labels_it_has_not_seen(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = queries.table(spark, sf, "documents")
    grades = grade.label_grades(queries.table(spark, sf, "labels"))
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = grade.train(docs, grades.where(~unseen), top=2)
    assert (np.diff(model.thresholds) > 0).all()
    rows = grade.graded(docs, model).join(grades.where(unseen), "doc_id").collect()
    right = sum(r.kept == (r.grade == 2) for r in rows)
    assert right >= 0.93 * len(rows)
    assert np.mean([r.expected_grade for r in rows if r.grade == 2]) > np.mean([r.expected_grade for r in rows if r.grade == 0]) + 0.5
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_op3_covers_all_rows_and_repeats(spark, sf, texts):
    runs = [Q["op3_quality_classifier"](spark, sf).orderBy("doc_id").collect() for _ in range(2)]
    assert runs[0] == runs[1] and [r.doc_id for r in runs[0]] == sorted(texts)


def test_op4_laws(spark, sf, texts):
    rows = Q["op4_flow_resharding"](spark, sf).collect()
    sizes, slots, old = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        sizes[r.shard] += r.size
        old[r.old_shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(sizes) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share, widest = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 4 * widest
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    least = sum(max(0, n - share) if i < 8 else n for i, n in old.items())
    assert moved <= least + 8 * widest


@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_flow_moves_the_fewest_bytes(supply, new):
    total = sum(supply)
    room = [total // new + (j < total % new) for j in range(new)]
    flow = reshard.transport(supply, room)
    assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(len(supply))] == supply
    assert [sum(n for (_, j), n in flow.items() if j == k) for k in range(new)] == room
    stay = sum(min(s, r) for s, r in zip(supply, room))
    assert sum(n for (i, j), n in flow.items() if i != j) == total - stay


def test_rewritten_shards_hold_their_rows(spark, sf):
    docs = queries.table(spark, sf, "documents")
    old = F.when(F.col("doc_id") < 40, 0).when(F.col("doc_id") < 80, 1).otherwise(2)
    assigned = reshard.reshard(docs, old, 3, 3, blocks=16)
    path = scratch_path(spark, "shards")
    kept = reshard.rewrite(docs, reshard.plan(docs, old, 3, 3, blocks=16), path)
    back = spark.read.parquet(path)
    want = {r.doc_id: (r.shard, r.slot) for r in assigned.collect() if r.shard not in kept}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == want
    assert all(r.old_shard == r.shard for r in assigned.collect() if r.shard in kept)


def test_op5(spark, sf, texts):
    items = [tuple(r) for r in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = plain.hits(texts, items)
    got = Q["op5_benchmark_decontamination"](spark, sf).collect()
    assert any(r.contaminated for r in got)
    for r in got:
        n, hit, named = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(named), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = con.execute(queries.ORACLES["op5_benchmark_decontamination"]).fetchall()
    assert {tuple(r)[:2] for r in got} == {(r[0], r[1]) for r in rows}
    assert sorted(tuple(r) for r in got) == sorted(rows)


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_small_blocks_and_many_passes_find_the_same(spark, block_bytes):
    rng = random.Random(block_bytes)
    vocabulary = ["a", "b", "ab", "Ba", "éa", "x1", "abab"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -"]) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 3, 5, 12, 14]))) for i in range(25)] + [(3, make(11)), (None, "x1 x1")]
    docs = {d: make(rng.randint(0, 60)) for d in range(40)} | {40: None}
    found = wumanber.occurrences(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes
    )
    want = plain.hits(docs, items)
    for r in found.collect():
        covered = set().union(*(range(a, b) for a, b in r.spans))
        assert (r.n_words, len(covered), sorted(str(x) for x in r["items"] if x is not None)) == want[r.doc_id]


def test_op6_recall(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = queries.table(spark, sf, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    data = np.array([r.embedding for r in rows], dtype=float)
    got = defaultdict(list)
    for r in Q["op6_hash_prefix_forest"](spark, sf).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    recall = []
    for q in ids[ids % 20 == 0]:
        score = data @ data[ids == q][0]
        score[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(s - score[ids == v][0]) < 1e-12 for _, v, s in own)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        recall.append((score.max(), len(want & {v for _, v, _ in own}) / 20))
    assert np.mean([r for _, r in recall]) >= 0.9
    # and by how near the nearest rows are, from sparse to dense surroundings
    assert all(np.mean([r for _, r in part]) >= 0.9 for part in np.array_split(sorted(recall), 10))


def test_forest_with_copies_and_split_subtrees(spark):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((300, 8)).round(3)
    data[100:220] = data[100]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    out = defaultdict(list)
    for r in forest.neighbours(table, lambda id: id % 20 == 0, top=5, least=10**9, block_rows=64).collect():
        out[r.query_id].append((r["rank"], r.vec_id))
    for q in range(0, 300, 20):
        score = (data * data[q]).sum(axis=1)
        score[q] = -np.inf
        assert [v for _, v in sorted(out[q])] == np.lexsort((np.arange(300), -score))[:5].tolist()


def test_queries_that_reach_too_few_ascend(spark):
    """Small subtrees, so that queries settle in several rounds."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    data = np.concatenate([rng.standard_normal((200, 16)), centre + 0.01 * rng.standard_normal((200, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    share = {}
    for least in (1, 300, 10**9):
        hits, found = 0, defaultdict(list)
        for r in forest.neighbours(table, lambda id: id % 20 == 0, top=20, trees=4, least=least, block_rows=16).collect():
            found[r.query_id].append((r["rank"], r.vec_id))
        for q in range(0, 400, 20):
            score = (data * data[q]).sum(axis=1)
            score[q] = -np.inf
            got = [v for _, v in sorted(found[q])]
            assert len(got) == 20  # whatever ``least`` is
            hits += len(set(got) & set(np.lexsort((np.arange(400), -score))[:20].tolist()))
        share[least] = hits / 400
    assert share[1] < share[300] < share[10**9] == 1, share


def test_descent_and_ascent():
    strings = np.array([0b0000, 0b0001, 0b0110, 0b0111, 0b1000], dtype=np.uint64) << np.uint64(60)
    wanted = np.array([0b0111, 0b1111], dtype=np.uint64) << np.uint64(60)
    assert forest.longest(strings, wanted).tolist() == [64, 1]
    low, high = forest.spans(strings, wanted, np.array([3, 1]))
    assert list(zip(low, high)) == [(2, 4), (4, 5)]
    who, level, n = forest.ascent(strings, wanted, 0)
    reach = {(w, k): m for w, k, m in zip(who.tolist(), level.tolist(), n.tolist())}
    assert [reach[0, k] for k in (64, 4, 3, 2, 1, 0)] == [1, 1, 2, 2, 4, 5] and (1, 2) not in reach and reach[1, 1] == 1 and reach[1, 0] == 5


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_shared_bits(a, b):
    want = 64 - (a ^ b).bit_length()
    assert forest.shared_bits(np.array([a], np.uint64), np.array([b], np.uint64)).tolist() == [want]


@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_the_order_is_a_permutation(n, key):
    places = order.permuted(np.arange(n), n, key)
    assert sorted(places.tolist()) == list(range(n))
    assert order.permuted(places, n, key, inverse=True).tolist() == list(range(n))


def test_op7_round_trip(spark, sf, texts):
    rows = Q["op7_training_order"](spark, sf).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    byte_level = queries.byte_level()
    target = scratch_path(spark, "order")
    docs = queries.table(spark, sf, "documents")
    places = []
    for layout in (docs, docs.repartition(5)):
        total = order.materialise(layout, **byte_level, target=target, key=20_261, end=50_256, pad=50_256, shard_rows=100, by_id=True)
        again = order.manifest(spark, target, 2048, shard_rows=100).collect()
        places.append({(r.id, r.piece, r.slot) for r in again})
    assert total == len(rows) and places[0] == places[1] and {p[:2] for p in places[0]} == {(r.doc_id, r.piece) for r in rows}
    assert rows == Q["op7_training_order"](spark, sf).collect()
    ids = dict(zip(texts, tokens.encode([t or "" for t in texts.values()], **byte_level)))
    where = {r.slot: r for r in again}
    seen = 0
    for block in order.resume(spark, target, total // 2).collect():
        for k in range(len(block.ids)):
            r, record = where[block.first_slot + k], np.frombuffer(block.records, "<u2")[k * 1024 : (k + 1) * 1024]
            own = np.append(ids[r.id], 50_256)
            start, size = packing.pieces_of(len(own), 1024)[r.piece]
            assert record[:size].tolist() == own[start : start + size].tolist() and (record[size:] == 50_256).all()
            assert r.shard == r.slot // 100 and r.offset == r.slot % 100 * 2048 and zlib.crc32(record.tobytes()) == r.crc32
            seen += 1
    assert seen >= total - total // 2


def test_files_hold_ranges_of_slots(spark, sf):
    target = scratch_path(spark, "order")
    docs = queries.table(spark, sf, "documents")
    total = order.materialise(docs, **queries.byte_level(), target=target, key=3, end=50_256, shard_rows=10, file_shards=2)
    files = spark.read.parquet(target).groupBy(F.input_file_name().alias("f")).agg(F.min("first_slot").alias("a"), F.max(F.col("first_slot") + F.size("ids")).alias("b")).orderBy("a").collect()
    assert [r.a for r in files] == list(range(0, total, 20)) and [r.b for r in files] == [*range(20, total, 20), total]
    assert order.resume(spark, target, total - 1).agg(F.sum(F.size("ids"))).first()[0] == (total - 1) % 10 + 1
    assert "GreaterThan(first_slot" in order.resume(spark, target, 5)._jdf.queryExecution().toString()


def test_ids_beyond_the_width_are_refused(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    for odd in ({"end": 70_000}, {"pad": 65_536}):
        with pytest.raises(ValueError, match="wide"):
            order.materialise(docs, **queries.byte_level(), target=scratch_path(spark, "order"), key=3, **odd)
    ids = np.array([1, 65_536], np.uint32)
    with pytest.raises(ValueError, match="wide"):
        order.body_of(ids, 2, "<u2")
    assert np.frombuffer(order.body_of(ids, 2, "<u4"), "<u4").tolist() == [1, 65_536, 2]
    assert np.frombuffer(order.body_of(ids[:1], None, "<u2"), "<u2").tolist() == [1]


def test_op8(spark, sf, texts):
    want = plain.groups(texts, 2)
    for r in Q["op8_minhash_near_dedup"](spark, sf).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(plain.shingles(texts[r.doc_id], 2)), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_copies_of_a_base_in_several_blocks(spark, monkeypatch):
    """Copies with edits of their own are like the base and often not like each other."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 8)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = {}
    for d in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randint(0, 10**6)}"
        docs[d] = " ".join(words)
    docs[30] = " ".join(base)
    docs |= {100 + d: " ".join(f"y{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 9))) for d in range(30)}
    out = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in out} == plain.groups(docs, 2)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 150), (150, 100), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[x] for x in range(61)} == {0} and {got[x] for x in [*range(100, 140), 150, 200]} == {100}


def test_op9_finds_repeats_and_fuzzy_copies(spark, sf, texts):
    rows = Q["op9_collinear_chaining"](spark, sf).collect()
    covered = defaultdict(set)
    words = {d: plain.re.findall("[^\x20\x09-\x0d]+", (t or "").translate(plain._LOWER)) for d, t in texts.items()}
    for r in rows:
        covered[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
        a = words[r.doc_id][r.first_word : r.first_word + r.n_words]
        b = words[r.other_id][r.other_first_word : r.other_first_word + r.other_words]
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 50 and r.similarity >= 0.8
        assert len(chain._common_words(*(np.array([hash(x) for x in y]) for y in (a, b)))[0]) >= r.matched_words
    seen = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            key = tuple(words[d][i : i + 50])
            if seen.setdefault(key, d) != d:
                assert set(range(i, i + 50)) <= covered[d]


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**7)}"
    passage = [word() for _ in range(90)]
    docs = {}
    for d in range(30):
        own = list(passage)
        for _ in range(5):
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([[], [word()], [own[i], word()]])
        docs[d] = " ".join([*(word() for _ in range(rng.randint(0, 200))), *own, *(word() for _ in range(rng.randint(0, 200)))])
    docs |= {100 + d: " ".join(word() for _ in range(300)) for d in range(20)}
    rows = chain.shared_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in rows} == set(range(1, 30)) and {r.other_id for r in rows} <= set(range(30))


def test_chains_take_the_best_predecessors():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        at, oat = (np.array([rng.randint(0, 60) for _ in range(n)]) for _ in range(2))
        size, cover = np.array([rng.randint(5, 12) for _ in range(n)]), np.array([rng.randint(5, 9) for _ in range(n)])
        last, olast = at + size - 5, oat + size - 5
        best = {}
        for i in sorted(range(n), key=lambda i: (at[i], oat[i])):
            best[i] = cover[i] + max([0, *(best[j] - 0.3 * (at[i] - last[j] + oat[i] - olast[j]) / 2 for j in best if last[j] < at[i] and olast[j] < oat[i])])
        top = chain.best_chains(at, oat, size, cover)
        value = lambda c: sum(cover[c]) - sum(0.3 * (at[b] - last[a] + oat[b] - olast[a]) / 2 for a, b in zip(c, c[1:]))
        assert abs(value(top[0]) - max(best.values())) < 1e-9 and sorted(x for c in top for x in c) == list(range(n))


def check_packing(rows, texts, byte_level, room=1024):
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = np.append(tokens.encode([texts[d] or ""], byte_level["path"])[0], 2).astype("<u4")
        own.sort(key=lambda r: r.piece)
        at = 0
        for p, r in enumerate(own):
            assert (r.piece, r.start) == (p, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert len(own) == 1 or p == 0 or r.length == room
            at += r.length
        assert at == len(ids) and (len(own) > 1) == (len(ids) > room)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(filled), -(-sum(r.length for r in rows) // room)


def test_op10(spark, sf, texts):
    used, least = check_packing(Q["op10_best_fit_packing"](spark, sf).collect(), texts, queries.byte_level())
    assert used <= 1.02 * least + 3


def test_sequences_hold_the_ids(spark, sf, texts):
    docs, byte_level = queries.table(spark, sf, "documents"), queries.byte_level()
    placed = packing.pack(docs, **byte_level, room=512, end=2, group_docs=40)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, placed, **byte_level, room=512, end=2).collect()}
    for r in placed.collect():
        assert zlib.crc32(whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=100, deadline=None)
def test_packing_places_each_size_once(sizes):
    out = packing.pack_sizes(np.array(sizes, dtype=np.int64), 64)
    assert sorted(k for x in out for k in x) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in x) <= 64 for x in out)
    assert len(out) <= 2 * -(-sum(sizes) // 64) if sizes else not out


def _fewest(sizes, room):
    """By trying everything: the fewest sequences."""
    best = [len(sizes)]

    def place(k, left):
        if len(left) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(left)
            return
        for g in set(left):
            if g >= sizes[k]:
                after = list(left)
                after[after.index(g)] -= sizes[k]
                place(k + 1, after)
        place(k + 1, [*left, room - sizes[k]])

    place(0, [])
    return best[0]


def test_packing_against_the_fewest_possible():
    rng = random.Random(9)
    used = least = 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 12) for _ in range(9)), reverse=True)
        n, fewest = len(packing.pack_sizes(np.array(sizes), 12)), _fewest(sizes, 12)
        assert fewest <= n <= fewest + 1
        used, least = used + n, least + fewest
    assert used <= 1.02 * least


@pytest.mark.parametrize("sparing", [False, True])
def test_each_document_goes_where_squares_sum_to_least(sparing):
    """Replays every choice from the bins as they were."""
    rng = random.Random(6)
    sizes, room = [rng.randint(1, 9) for _ in range(80)], 10
    for k in range(1, len(sizes)):
        bins = packing.sum_of_squares(np.array(sizes[: k + 1]), room, sparing)
        left = lambda n: [room - x for x in (sum(sizes[i] for i in b if i < n) for b in bins) if x]
        squares = lambda gaps: sum(gaps.count(g) ** 2 for g in set(gaps) - {0})
        now, size = left(k), sizes[k]
        choices = [] if sparing and any(g >= size for g in now) else [squares([*now, room - size])]
        for g in set(now):
            if g >= size:
                after = list(now)
                after[after.index(g)] = g - size
                choices.append(squares(after))
        assert squares(left(k + 1)) == min(choices)


def test_pipeline_stage_by_stage(spark, sf, texts):
    docs = queries.table(spark, sf, "documents")
    rows = {}
    for name, stage in P.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        rows[name] = docs, docs = docs, spark.read.parquet(path)
    frames = {name: [{r.doc_id: r.text for r in f.collect()} for f in pair] for name, pair in list(rows.items())[:-1]}
    before, after = frames["MinHash near-dedup"]
    want = plain.groups(before, 5)
    assert after == {d: t for d, t in before.items() if want[d] == d}
    before, after = frames["suffix-array dedup"]
    left = plain.left_of({d: t.encode() for d, t in before.items()})
    for d, t in before.items():
        if left[d][1] == 0:
            assert after[d] == t
        elif t.isascii() and left[d][1] < left[d][0]:
            assert hashlib.sha256(after[d].encode()).hexdigest() == left[d][3]
    before, after = frames["benchmark decontamination"]
    items = [tuple(r) for r in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    hit = plain.hits(before, items)
    assert after == {d: t for d, t in before.items() if not hit[d][1]}
    check_packing(docs.collect(), after, queries.byte_level())
    total = P.run(spark, sf)
    assert total.count() == docs.count() and total.columns == docs.columns


def test_a_chain_without_passage_hides_no_other(spark):
    """Document 9 shares with 1 runs of 20 words, 10 others between them, and 60 words in a row with 5."""
    new = [f"w{i}" for i in range(150)]
    old = [w if i % 30 < 20 else f"x{i}" for i, w in enumerate(new)]
    five = [f"y{i}" for i in range(40)] + new[40:100] + [f"z{i}" for i in range(40)]
    docs = {1: old, 5: five, 9: new}
    rows = chain.shared_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()
    assert (9, 40, 60, 5, 40, 60) in {(r.doc_id, r.first_word, r.n_words, r.other_id, r.other_first_word, r.other_words) for r in rows}


def test_shared_passages_do_not_depend_on_the_split(spark):
    """A line that 40 documents have, and one that only the first and the last have, beside each other."""
    line, rare = [f"l{i}" for i in range(45)], [f"r{i}" for i in range(45)]
    docs = [(k, [f"a{k}x{i}" for i in range(25)] + line + [f"b{k}x{i}" for i in range(25)]) for k in range(1, 60)]
    docs = [(0, line + rare), *docs, (60, line + rare)]
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs], "doc_id long, text string")
    got = []
    for split in (table.coalesce(1), table.repartition(61, "doc_id"), table.orderBy(F.col("doc_id").desc()).coalesce(1), table.repartitionByRange(2, "doc_id")):
        got.append(sorted(tuple(r) for r in chain.shared_passages(split).collect()))
    assert got[0] == got[1] == got[2] == got[3]
    assert (60, 0, 90, 0, 0, 90, 90, 1.0) in got[0]


def test_lanes_give_the_matches_of_one_shard():
    rng = np.random.default_rng(4)
    rows = np.unique(np.array([(rng.integers(3) if rng.random() < 0.7 else rng.integers(40), rng.integers(300), rng.integers(50)) for _ in range(1500)], chain.ENTRY))
    whole = np.sort(chain._pairs(rows, chain.COMMON))
    for pieces in (1, 2, 7):
        piece, sent = rng.integers(pieces, size=300)[rows["doc"]], {}
        for p in range(pieces):
            for batch in chain._dealt(rows[piece == p], 2):
                for k, data in zip(batch.column("k").to_pylist(), batch.column("data").to_pylist()):
                    sent.setdefault(k, []).append(data)
        assert min(sent) < 0
        lanes, out = {}, []
        for k, data in sent.items():
            table, key = pa.table({"k": [k] * len(data), "data": pa.array(data, pa.binary())}), (pa.scalar(k),)
            out.append(chain.unpack(chain._link(4)(key, table), chain.MATCH, chain.rows_of_planes))
            for r in chain._to_lanes(2)(key, table).to_pylist():
                lanes.setdefault(r["k"], []).append(r["data"])
        for k, data in lanes.items():
            out.append(chain.unpack(chain._link_lane(4)((pa.scalar(k),), pa.table({"k": [k] * len(data), "data": pa.array(data, pa.binary())})), chain.MATCH, chain.rows_of_planes))
        assert np.array_equal(np.sort(np.concatenate(out)), whole)


def test_passages_of_frequent_lines_reach_a_document_that_holds_them(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    docs = {1: a, 2: b, 5: a + b, 7: a, 8: b, 9: a + b}
    rows = chain.shared_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.other_id, r.matched_words) for r in rows] == [(9, 0, 60, 5, 60)]


def test_every_equal_run_lies_in_a_passage(spark):
    """Texts composed of few lines, in any order and with repeats, against all pairs of runs."""
    rng = random.Random(8)
    lines = [[f"l{k}w{i}" for i in range(rng.choice((4, 9, 17, 30)))] for k in range(9)]
    docs = {k: [w for _ in range(rng.randint(2, 14)) for w in rng.choice(lines)] for k in range(250)}
    rows = chain.shared_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string").repartition(5)).collect()
    spans, least, known, runs = defaultdict(list), chain.LEAST_WORDS, set(), 0
    for r in rows:
        spans[r.doc_id].append((r.first_word, r.first_word + r.n_words))
    for k, words in docs.items():
        own = [tuple(words[i : i + least]) for i in range(len(words) - least + 1)]
        for i, run in enumerate(own):
            if run in known:
                runs += 1
                assert any(x <= i and i + least <= y for x, y in spans[k]), (k, i)
        known.update(own)
    assert runs > 500


def test_resharding_writes_the_shards_it_reports(spark, sf, texts, monkeypatch):
    calls, write = [], reshard.rewrite
    monkeypatch.setattr(reshard, "rewrite", lambda docs, plan, path: calls.append((path, plan, write(docs, plan, path))) or calls[-1][2])
    rows = {r.doc_id: r for r in Q["op4_flow_resharding"](spark, sf).collect()}
    assert len(calls) == 1 and set(rows) == set(texts)
    path, plan, untouched = calls[0]
    written = {r.doc_id: r for r in spark.read.parquet(path).collect()}
    assert set(written) == {k for k, r in rows.items() if r.shard not in untouched}
    assert all((w.shard, w.slot, w.text) == (rows[k].shard, rows[k].slot, texts[k]) for k, w in written.items())
    for a in reshard.assigned(queries.table(spark, sf, "documents"), plan).collect():
        r = rows[a.doc_id]
        assert (r["size"], r.text_crc32, r.old_shard, r.shard, r.slot) == (a["size"], a.text_crc32, a.old_shard, a.shard, a.slot)


@pytest.mark.parametrize("others", [2, 20])
def test_alike_passages_behind_frequent_lines_are_found(spark, others):
    """Documents 1000 and 3000 are alike, with an edit in every 14 words; each line of theirs is in documents before both and between them."""
    lines = [[f"l{k}w{i}" for i in range(13)] for k in range(8)]
    own = lambda d: [f"o{d}x{i}" for i in range(20)]
    docs = {d: [w for k, line in enumerate(lines) for w in [*line, f"e{d}k{k}"]] for d in (1000, 3000)}
    docs |= {first + k * others + j: [*own(first + k * others + j), *line, *own(-first - k * others - j)] for first in (0, 2000) for k, line in enumerate(lines) for j in range(others)}
    rows = chain.shared_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string").repartition(3)).collect()
    assert [(r.doc_id, r.other_id, r.first_word, r.n_words, r.matched_words) for r in rows] == [(3000, 1000, 0, 111, 104)]
