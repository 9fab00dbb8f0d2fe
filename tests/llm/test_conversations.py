"""Prefix trie, structure repair and lattice likelihood against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptlens.llm import lattice, minhash, queries, repair, sequence, trie
from tests.llm import plain

Q = queries.QUERIES
KIND = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark, sf):
    out = defaultdict(list)
    for r in queries.table(spark, sf, "conversations").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect():
        out[r.conv_id].append((r.turn, r.role, r.text))
    return out


def written(spark, tmp_path, rows):
    """Odd conversations as a table: other columns of clashing names, and other tables' absence, don't matter."""
    frame = spark.createDataFrame(rows, KIND).select("*", *(F.lit("clash").alias(c) for c in ("k", "d", "name", "pos", "digest", "block", "word", "goal", "total", "conv")))
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_op11(spark, sf, conversations):
    seqs = plain.rebuilt({c: [(r or "", x or "") for _, r, x in rows] for c, rows in conversations.items()})
    got = Q["op11_prefix_trie"](spark, sf).collect()
    assert {tuple(r) for r in got} == plain.trie(seqs) and len(got) == len(plain.trie(seqs))


@pytest.mark.parametrize("block", [4, 1024])
def test_tries_of_deep_and_shared_sequences(spark, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "ENDS", 2)
    rng = random.Random(block)
    stems = [[("user", rng.choice("xyz") * rng.randint(0, 3)) for _ in range(rng.randint(1, 30))] for _ in range(4)]
    seqs = {c: tuple((s := rng.choice(stems))[: rng.randint(0, len(s))] + [("assistant", rng.choice("pq"))] * rng.randint(0, 2)) for c in range(-5, 40)}
    seqs[50] = ()
    turns = [(c, d + 1, r, x) for c, s in seqs.items() for d, (r, x) in enumerate(s)]
    frame = spark.createDataFrame(turns, "conv long, d long, role string, text string")
    frame = frame.select("conv", "d", sequence.digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    each = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "conv long, n long")
    got = trie.prefix_trie(frame, each).drop("name").collect()
    assert {tuple(r) for r in got} == plain.trie(seqs) and len(got) == len(plain.trie(seqs))


def test_one_conversation_of_a_third_of_all_rows_is_numbered_in_parts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("key"), (F.col("id") * 37 % 1000).alias("turn"))
    out = sequence.numbered(rows.repartition(8), "key", [F.col("turn").asc_nulls_first()])
    hot = out.where("key = 7").orderBy("pos").collect()
    assert [r.pos for r in hot] == list(range(1, 1001)) and [r.turn for r in hot] == sorted(r.turn for r in hot)
    assert {r.total for r in hot} == {1000} and out.where("key != 7 and (pos != 1 or total != 1)").count() == 0
    plan = rows.repartitionByRange(4, F.col("key"), F.col("turn")).withColumn("p", F.spark_partition_id())
    assert plan.where("key = 7").select("p").distinct().count() > 1


ODD = [
    (1, None, None, None), (1, None, "user", "first?"), (1, 3, "user", ""), (1, 3, "", "no role."), (1, 9, "tool", "x" * 5000), (2, 0, "user", "only"),
    (2, 0, "user", "only"), (3, 5, "System", "é é."), (3, 6, "system", "\x0b\t"), (3, 7, "assistant", "日本語"), (-4, -2, "user", "neg!"), (-4, 1 << 40, "assistant", "far."),
    (10, 0, "assistant", "a."), (11, 0, "system", "s."), (11, 1, "system", "s."), (12, None, "user", None), (12, None, "user", "b"),
]


def ordered(rows):
    """Rows of each conversation by turn, nulls first; ties by the digest that the operators state."""
    def tie(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]

    return lambda blank: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(*(blank if x is None else x for x in r[1:]))))


def test_op11_on_odd_rows(spark, tmp_path):
    sf = written(spark, tmp_path, [*ODD, (None, 1, "user", "nobody's")])
    convs = defaultdict(list)
    for c, *r in ODD:
        convs[c].append(tuple(r))
    convs = {c: [(r or "", x or "") for _, r, x in ordered(rows)("")] for c, rows in convs.items()}
    # the remainder of a negative id is negative, as in SQL
    seqs = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        seqs[c] = tuple(convs.get(base, [])[:h] + own[h:])
    assert {tuple(r) for r in Q["op11_prefix_trie"](spark, sf).collect()} == plain.trie(seqs)


def test_no_conversations(spark, tmp_path):
    sf = written(spark, tmp_path, [])
    assert Q["op11_prefix_trie"](spark, sf).collect() == [] and Q["op13_structure_repair"](spark, sf).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_sql_says_the_same(spark, sf, tmp_path, name):
    odd = written(spark, tmp_path, [*ODD, (None, 1, "user", "nobody's"), (None, None, "assistant", "either.")])
    for folder, files in ((sf, "conversations.parquet"), (odd, "conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/{files}'")
        got = Q[name](spark, folder)
        rows = con.execute(queries.ORACLES[name])
        assert [d[0] for d in rows.description] == got.columns
        assert sorted(map(str, rows.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_op13(spark, sf, conversations):
    want = {(c, *plain.repaired(plain.damaged(c, rows))) for c, rows in conversations.items()}
    got = Q["op13_structure_repair"](spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_op13_on_odd_rows(spark, tmp_path):
    rows = [*ODD, (None, 1, "user", "nobody's"), (None, None, "assistant", "either.")]
    sf = written(spark, tmp_path, rows)
    convs = defaultdict(list)
    for c, *r in rows:
        convs[c].append(tuple(r))
    want = {(c, *plain.repaired(ordered(plain.damaged(c, own))(" "))) for c, own in convs.items()}
    assert {tuple(r) for r in Q["op13_structure_repair"](spark, sf).collect()} == want


@pytest.mark.parametrize("block", [1, 3, 256])
def test_repairs_of_random_conversations(spark, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    convs = {
        c: [(t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "ubuntu", ""]), rng.choice(["yes.", "no", " ", f"text {t}!", f"cut {t}"])) for t in range(rng.randint(1, 14))]
        for c in range(120)
    }
    frame = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], KIND).repartition(5)
    audits, turns = repair.repair(frame)
    prints = {r.k: r.repaired_sha256 for r in repair.fingerprints(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {int(r.k): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, prints.get(r.k, empty)) for r in audits.collect()}
    assert got == {c: plain.repaired(rows) for c, rows in convs.items()}
    legal = re.compile("(s?(ua)+)?")
    by_conv = defaultdict(str)
    for r in turns.collect():
        by_conv[r.k] += r.role[:1]
    assert all(legal.fullmatch(x) for x in by_conv.values())


@given(st.lists(st.text("suaxSUAXD", min_size=1, max_size=9), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_shared_suffixes_give_each_word_s_own_answer(words):
    import pyarrow as pa

    backs = sorted({w[::-1] for w in words})
    goal = ",".join(map(str, repair.END))
    batch = pa.RecordBatch.from_pydict({"goal": [goal] * len(backs), "back": backs})
    for row in pa.Table.from_batches(repair._walk(iter([batch]))).to_pylist():
        fault = {"D": "blank"}
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), f"t{i}", fault.get(c, "truncated" if c.isupper() else "")) for i, c in enumerate(row["word"])]
        cost, audit, _ = plain.cheapest(rows)
        code = row["edits"][0] + repair.CLOSING[row["states"][0]]
        assert (row["costs"][0], code.translate(str.maketrans("UAua", "RRII"))) == (cost, audit)


def test_each_node_is_computed_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(repair, "_node", lambda symbol, after, f=repair._node: made.append(symbol) or f(symbol, after))
    import pyarrow as pa

    backs = sorted(["aua", "auau", "auas", "aus", "u"])
    list(repair._walk(iter([pa.RecordBatch.from_pydict({"goal": ["0,4,2,0"] * 5, "back": backs})])))
    assert len(made) == len({b[:n] for b in backs for n in range(1, len(b) + 1)})


def model():
    return queries.vocabulary("piece_bpe_32k.model")


def pieces(weight):
    """The vocabulary as a table of byte strings, walked out of the trie."""
    child, ends, _, _ = lattice.vocabulary(model())
    out, stack = {}, [(0, b"")]
    while stack:
        node, key = stack.pop()
        if ends[node] >= 0:
            out[key] = float(np.exp(weight[ends[node]]))
        stack += [(int(child[node, b]), key + bytes([b])) for b in np.flatnonzero(child[node])]
    return out


def test_vocabulary_is_the_model_s(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model())
    own = set(pieces(np.zeros(m.get_piece_size())))
    want = {bytes([b]) for b in range(256)}
    for i in range(m.get_piece_size()):
        body = m.id_to_piece(i)
        if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and "▁" not in body[1:]:
            want.add((b"\xff" + body[1:].encode()) if body[0] == "▁" else body.encode())
    assert own == want


@pytest.mark.parametrize("flat", [5, 1 << 18])
def test_forward_and_backward_against_all_segmentations(flat, monkeypatch):
    monkeypatch.setattr(lattice, "FLAT", flat)
    _, _, prior, _ = lattice.vocabulary(model())
    weight = np.log(np.maximum(prior, 1e-300))
    table = pieces(weight)
    words = [w.encode() for w in ("the", "thethe", "internationalisation", "日本語", "x", "é" * 40, "a▁b", "\x00<|endoftext|>", "zzzzqqqq")]
    groups = [words] if flat > 100 else [[w] for w in words]  # words of more than FLAT bytes come alone
    for group in groups:
        data = np.frombuffer(b"\xff" + b"\xff".join(group), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(w) + 1 for w in group])))
        counts = np.arange(1, len(group) + 1)
        total, expected = lattice.forward_backward(data, offsets, weight, model(), counts)
        for w, t in zip(group, total):
            assert math.isclose(t, plain.segmentations(b"\xff" + w, table), rel_tol=1e-9)
        # pieces' expected bytes are the words' bytes
        child, ends, _, _ = lattice.vocabulary(model())
        size = np.zeros(len(weight))
        stack = [(0, 0)]
        while stack:
            node, n = stack.pop()
            if ends[node] >= 0:
                size[ends[node]] = n
            stack += [(int(c), n + 1) for c in child[node][child[node] > 0]]
        assert math.isclose(float(expected @ size), sum(int(c) * (len(w) + 1) for c, w in zip(counts, group)), rel_tol=1e-9)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def likelihoods(docs, weight):
    words = [(d, re.findall("[^\x20\x09-\x0d]+", (x or "").translate(LOWER))) for d, x in docs]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(t for d, w in words if not held[d] for t in [*w, " "])
    n, v = sum(counts.values()), len(counts)
    table, end = pieces(weight), math.exp(weight[lattice.vocabulary(model())[3]])
    rated: dict = {}
    out = []
    for d, w in words:
        for t in w:
            if t not in rated:
                rated[t] = plain.segmentations(b"\xff" + t.encode(), table) / math.log(10)
        base = sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in [*w, " "])
        out.append((d, held[d], len(w) + 1, sum(counts[t] > 0 for t in [*w, " "]), n, base, sum(rated[t] for t in w) + math.log10(end)))
    return out


def alike(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], round(r[5], 4), round(r[6], 4))

    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [1 << 18, 50])
def test_op12(spark, sf, frequent, monkeypatch):
    """Words looked up and words joined give the same."""
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    learned = []
    monkeypatch.setattr(lattice, "_learn", lambda *a, f=lattice._learn: learned.append(f(*a)) or learned[-1])
    got = Q["op12_lattice_likelihood"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    alike(got, likelihoods(docs, learned[0]))


def test_op12_on_odd_rows(spark, documents, nothing, monkeypatch):
    learned = []
    monkeypatch.setattr(lattice, "_learn", lambda *a, f=lattice._learn: learned.append(f(*a)) or learned[-1])
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    odd = documents.where("doc_id is null or doc_id != 11").unionByName(documents.where("doc_id = 7"))
    got = lattice.score(odd, model(), held).withColumn("held", F.lit(False)).select("doc_id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = likelihoods([(r.doc_id, r.text) for r in odd.collect()], learned[0])
    alike(got, [(r[0], False, *r[2:]) for r in want])
    assert lattice.score(nothing, model(), held).collect() == []
    alone = lattice.score(documents.where("doc_id in (4, 6)"), model(), F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}


def test_learned_weights_suit_texts_they_have_not_seen(spark, sf, monkeypatch):
    def held_out(rounds):
        monkeypatch.setattr(lattice, "ROUNDS", rounds)
        rows = Q["op12_lattice_likelihood"](spark, sf).where("held_out").collect()
        return sum(r.score for r in rows) / sum(r.n_tokens for r in rows)

    prior, learned = held_out(0), held_out(2)
    assert learned > prior + 0.3


def test_words_that_defeat_hashes_of_powers_have_different_keys():
    a = np.array([bin(i).count("1") % 2 for i in range(1024)], dtype=np.uint8) + 97
    data = np.concatenate((a, 195 - a))
    first, second = lattice.keys(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert first != second


def test_such_words_link_no_documents(spark):
    """Words of Thue and Morse and their complements: unlike texts stay apart, equal ones don't."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [a, texts_of(a), a, f"{a} x", f"{texts_of(a)} x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got == plain.groups(dict(enumerate(texts)), 2) and got[1] == 1 and got[2] == 0


def texts_of(a):
    return a.translate(str.maketrans("ab", "ba"))
