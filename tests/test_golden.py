"""Known records: before and after values that must come out exactly."""

import hashlib
import hmac

from pyspark.sql import functions as F

from promptlens.functions import detectors as D
from promptlens.functions import hashing as H

# fixed values: one documented prompt with its expected findings
PROMPT = (
    "Draft the state Workers' Comp claim narrative for Sarah Jenkins (Email: s.jenkins@cme-mfg.com, "
    "SSN: 000-31-7742, DOB: 08/19/1984) who suffered an L4-L5 lumbar disc herniation clearing a "
    "jammed press on Line 3."
)
MASKED = (
    "Draft the state Workers' Comp claim narrative for [PERSON_NAME] (Email: [EMAIL_ADDRESS], "
    "SSN: ***-**-7742, DOB: [DATE_OF_BIRTH]) who suffered an L4-L5 lumbar disc herniation clearing a "
    "jammed press on Line 3."
)
TYPES = ["DATE_OF_BIRTH", "EMAIL_ADDRESS", "MEDICAL_TERM", "PERSON_NAME", "US_SOCIAL_SECURITY_NUMBER"]

# fixed values: employees and the unkeyed ids their emails must give
ROSTER = {
    "m.thompson@cme-mfg.com": "usr_37df4fec",
    "e.rostova@cme-mfg.com": "usr_8b239fef",
    "d.kowalski@cme-mfg.com": "usr_4230c855",
    "s.jenkins@cme-mfg.com": "usr_5c9a1a49",
}


def test_documented_prompt(spark):
    detectors = D.default_detectors(["Sarah Jenkins"])
    df = spark.createDataFrame([(PROMPT,)], "t string").withColumn("types", D.info_types(F.col("t"), detectors))
    row = D.mask_column(df, "t", "m", "types", detectors).select(
        "types", "m", D.mask_text(F.col("t"), detectors).alias("m2"),
        D.risk_level(F.col("types")).alias("risk"), D.is_toxic(F.col("types")).alias("toxic"),
    ).first()
    assert row.types == TYPES
    assert row.m == row.m2 == MASKED
    assert (row.risk, row.toxic) == ("CRITICAL", True)


def test_tagged_style(spark):
    text = "SSN: 000-31-7742, Acct #4491028812, Routing #072000326"
    row = spark.createDataFrame([(text,)], "t string").select(
        D.mask_text(F.col("t"), D.PATTERN_DETECTORS, "tagged").alias("m")
    ).first()
    assert row.m == (
        "SSN: [US_SSN: ***-**-7742], Acct #[BANK_ACCT: ******8812], Routing #[US_BANK_ROUTING_MICR]"
    )


def test_roster_ids(spark):
    rows = spark.createDataFrame([(e,) for e in ROSTER], "e string").select(
        "e", H.salted_actor_hash(F.col("e")).alias("h")
    )
    assert {r.e: r.h for r in rows.collect()} == ROSTER


def test_hmac_equals_python(spark):
    emails = ["a@b.example", "Ünï@b.example", "x" * 200]
    for key in (b"short", H.derive_key("seed"), b"k" * 100):
        k = H.ActorKey(H.key_table(spark, key))
        rows = spark.createDataFrame([(e,) for e in emails], "e string").select(
            "e", H.hmac_sha256(F.col("e"), *k.pads()).alias("d"), H.actor_hash(F.col("e"), k).alias("a"),
            H.format_actor_hash(H.email_digest(F.col("e"), k)).alias("b"),
        )
        for r in rows.collect():
            want = hmac.new(key, r.e.encode(), hashlib.sha256).digest()
            assert bytes(r.d) == want
            assert r.a == r.b == "usr_" + want.hex()[:8]


def test_keys():
    assert H.derive_key("a") == hashlib.sha256(b"a").digest()
    assert len(H.derive_key()) == 32 and H.derive_key() != H.derive_key()


def test_actor_format(spark):
    cases = {
        "": "usr_anonymous",
        "SQ8tf6T2KLX1Z0cLlmXdASABmTnPoQvbBi48X5qJ/sU=": "usr_490f2d7f",  # fixed value
        "!!Not base64, at ALL": "usr_notbase6",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string").select(
        "d", H.format_actor_hash(F.col("d")).alias("a")
    )
    got = {r.d: r.a for r in rows.collect()}
    assert got == cases | {None: "usr_anonymous"}


def test_sql_names_equal_columns(spark):
    from promptlens import fixed_values as V
    from promptlens.functions import sql

    sql.register(spark)
    rows = [("", []), ("SQ8tf6T2KLX1Z0cLlmXdASABmTnPoQvbBi48X5qJ/sU=", [V.SSN, V.ROUTING]), ("!!no base64", [V.DOB])]
    out = spark.createDataFrame(rows, "d string, t array<string>").select(
        F.expr("format_dlp_actor_hash(d)").alias("a"), H.format_actor_hash(F.col("d")).alias("b"),
        F.expr("score_dlp_risk(t)").alias("c"), D.risk_level(F.col("t")).alias("e"),
    )
    for r in out.collect():
        assert (r.a, r.c) == (r.b, r.e)
