"""Dictionaries kept as tables against the same terms as patterns."""

import random

import pytest
from pyspark.sql import functions as F

from checks import base
from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.operators import curate as C
from promptlens.operators import deidentify as Deid
from promptlens.operators import dictionary
from promptlens.operators.dictionary import mask_terms
from tests.test_plans import nodes, output

TERMS = [
    ("Ann Lee", V.PERSON), ("Ann", V.PERSON), ("Lee Roy", V.PERSON), ("O'Brien", V.PERSON), ("René", V.PERSON), ("Bo van Dyk", V.PERSON), ("Lee Roy Systems", "COMPANY"),
    ("C++", "LANGUAGE"), ("a_b", "VARIABLE"), ("日本", "PLACE"), ("sprain", V.MEDICAL), ("rotator cuff tear", V.MEDICAL), ("Ann Lee", "COMPANY"), ("", "NOTHING"),
]
WORDS = ["Ann", "Lee", "Roy", "Systems", "O'Brien", "René", "Bo", "van", "Dyk", "C++", "a_b", "日本", "Sprain", "rotator", "CUFF", "tear", "and", "x", "Anna", "AnnLee", "xC++", "123-45-6789"]


def rows(spark, texts):
    return spark.createDataFrame([(i, "n", f"{i}@x.example", t) for i, t in enumerate(texts)], "id long, employee_name string, employee_email string, prompt_text string")


def both(spark, texts, terms, detectors=D.PATTERN_DETECTORS):
    frame, table, key = rows(spark, texts), spark.createDataFrame(terms, "term string, info_type string"), base.test_key(spark)
    as_patterns = Deid.deidentify(frame, [*detectors, *D.dictionary_detectors(table)], key)
    as_table = Deid.deidentify(frame, detectors, key, terms=table)
    def of(df):
        return {r.id: (r.prompt_text_masked, r.dlp_info_types) for r in df.collect()}

    return of(as_table), of(as_patterns)


def test_random_texts_as_by_patterns(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "-", ", ", "'s ", "_", "é "]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got, want = both(spark, texts + texts[:50], TERMS)
    assert got == want
    assert sum("[PERSON_NAME]" in m for m, _ in want.values()) > 100 and sum("[LANGUAGE]" in m for m, _ in want.values()) > 20


def test_examples(spark):
    texts = ["Ann Lee met Lee Roy Systems", "Anna Lee's Ann, Rotator Cuff Tear", "ann lee", None, "", "Ann" * 3, "SSN 123-45-6789 of René", "write to Ann@x.example"]
    got, _ = both(spark, [t for t in texts if t is not None], TERMS)
    assert got[0] == ("[COMPANY] met [COMPANY]", ["COMPANY", V.PERSON])
    assert got[1] == ("Anna Lee's [PERSON_NAME], Rotator Cuff Tear", [V.MEDICAL, V.PERSON])
    assert got[2] == ("ann lee", []) and got[3] == ("", []) and got[4] == ("AnnAnnAnn", [])
    assert got[5][0] == "SSN ***-**-6789 of [PERSON_NAME]"
    # a name within an email was there, though the email's mask hides it
    assert got[6] == ("write to [EMAIL_ADDRESS]", [V.EMAIL, V.PERSON])
    table = spark.createDataFrame(TERMS, "term string, info_type string")
    frame = rows(spark, [None, "Ann"])
    key = base.test_key(spark)
    assert [r.prompt_text_masked for r in Deid.deidentify(frame, D.PATTERN_DETECTORS, key, terms=table).orderBy("id").collect()] == [None, "[PERSON_NAME]"]
    none = Deid.deidentify(frame, D.PATTERN_DETECTORS, key, terms=table.limit(0))
    assert [r.prompt_text_masked for r in none.orderBy("id").collect()] == [None, "Ann"] and "prompt_text" not in none.columns


def test_a_million_terms(spark, sf):
    many = spark.range(1_000_000).select(F.concat(F.lit("Person "), F.hex(F.xxhash64("id"))).alias("term"), F.lit(V.PERSON).alias("info_type"))
    hit = many.where("term like 'Person A%'").limit(20).collect()
    texts = [f"call {r.term}, or {r.term}X" for r in hit] + ["Person 1234 is nobody"]
    out = Deid.deidentify(rows(spark, texts), D.PATTERN_DETECTORS, base.test_key(spark), terms=many).orderBy("id").collect()
    assert [r.prompt_text_masked for r in out[:20]] == [f"call [PERSON_NAME], or {r.term}X" for r in hit]
    assert all(r.dlp_info_types == [V.PERSON] for r in out[:20]) and out[20].prompt_text_masked == texts[20]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_nothing_raw_moves(spark, sf, broadcast):
    """Exchanges carry digests, places and ciphertext only; duplicates and flags follow as ever."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        from checks import telemetry as T

        terms = spark.createDataFrame([(n, V.PERSON) for n in T.SUBJECT_NAMES], "term string, info_type string")
        detectors = D.default_detectors()
        out = C.curate(base.messages(spark, sf), detectors, base.test_key(spark), terms=terms)
        exchanges = [n for n in nodes(out) if "Exchange" in n.nodeName()]
        raw = {"data", "entry", "prompt_text", "employee_name", "employee_email", "_raw", "_masked"}
        assert exchanges and not any(output(n) & raw for n in exchanges)
        # texts pass the first exchanges sealed: masked text is binary there until the join is done
        sealed = [a.dataType().simpleString() for n in exchanges for a in attributes(n) if a.name() == "prompt_text_masked" and "_text_key" in output(n)]
        assert set(sealed) <= {"binary"}
        want = C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark))
        assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def attributes(node):
    it = node.output().iterator()
    while it.hasNext():
        yield it.next()


def test_longer_actor_ids_reach_every_pipeline(spark, sf):
    key = base.test_key(spark)
    for digits in (8, 16):
        rows = C.curate(base.messages(spark, sf), base.DETECTORS, key, digits=digits)
        assert {len(r[0]) for r in rows.select("anonymous_actor_hash").distinct().collect()} == {4 + digits}
    staged = C.deliveries(base.disturbed(spark, sf), base.DETECTORS, key, digits=16)
    assert staged.where("reason is null and length(anonymous_actor_hash) != 20").count() == 0


def test_masks_by_hand(spark):
    table = spark.createDataFrame([("x y", "A"), ("y z", "B"), ("z", "B")], "term string, info_type string")
    frame = spark.createDataFrame([("x y z",)], "prompt_text string").withColumn("prompt_text_masked", F.col("prompt_text")).withColumn("dlp_info_types", F.array().cast("array<string>"))
    assert mask_terms(frame, table, base.test_key(spark)).first() == ("[A] [B]", ["A", "B"])


def test_first_tokens_tell_which_runs_are_built(spark, monkeypatch):
    """Only runs that a term may begin are joined; case beyond ASCII, and more first tokens than are told apart, lose none."""
    terms = spark.createDataFrame([("Ann Lee", "PERSON_NAME"), ("ΟΣ'Α", "MEDICAL_TERM"), ("sprain", "MEDICAL_TERM")], "term string, info_type string")
    key = base.test_key(spark)
    texts = ["Ann Lee and ann lee", "an οσ'α", "AN ΟΣ'Α", "a Sprain", "nothing"]
    rows = spark.createDataFrame([(t, t, []) for t in texts], "prompt_text string, prompt_text_masked string, dlp_info_types array<string>")

    def found():
        return {r.prompt_text_masked: r.dlp_info_types for r in dictionary.mask_terms(rows, terms, key).collect()}

    want = {"[PERSON_NAME] and ann lee": ["PERSON_NAME"], "an οσ'α": ["MEDICAL_TERM"], "AN ΟΣ'Α": ["MEDICAL_TERM"], "a Sprain": ["MEDICAL_TERM"], "nothing": []}
    assert found() == want
    pad, _ = key.pads()
    starts = dictionary._starts(terms, pad, [False, True])
    may = spark.createDataFrame([(t,) for t in ("Ann", "ann", "SPRAIN", "a", "Σ")], "t string").select("t", dictionary._may_start(pad, F.col("t"), starts).alias("m"))
    assert {r.t for r in may.where("m").collect()} == {"Ann", "SPRAIN", "Σ"}
    monkeypatch.setattr(dictionary, "MOST_STARTS", 0)
    assert found() == want
