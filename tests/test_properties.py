"""Properties of detection and masking over generated texts."""

import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptlens.functions import detectors as D

pieces = st.sampled_from(
    ["000-31-7742", "123-45-6789", "666-45-6789", "912-45-6789", "Acct #4491028812", "Routing #072000326",
     "08/19/1984", "a.b@c.example", "x_@y.co", "é", "fracture", "Ann Lee", "Ann", "1", "-", "/", "@", ".", " ", "\n", "#"]
) | st.text(alphabet=string.ascii_letters + string.digits + "._%+-@ /#é", max_size=6)
texts = st.lists(st.lists(pieces, max_size=8).map("".join), min_size=40, max_size=60)

# The same rules in another regex engine, with ASCII boundaries.
ASCII = re.ASCII
ORACLE = {
    "US_SOCIAL_SECURITY_NUMBER": re.compile(r"\b(?!666|9\d\d)\d{3}-\d{2}-\d{4}\b", ASCII),
    "FINANCIAL_ACCOUNT_NUMBER": re.compile(r"Acct #\d{10}\b", ASCII),
    "US_BANK_ROUTING_MICR": re.compile(r"Routing #\d{9}\b", ASCII),
    "DATE_OF_BIRTH": re.compile(r"\b\d{2}/\d{2}/\d{4}\b", ASCII),
    "EMAIL_ADDRESS": re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ASCII),
    "PERSON_NAME": re.compile(r"\bAnn Lee\b", ASCII),
    "MEDICAL_TERM": re.compile(r"\bfracture\b", ASCII | re.I),
}
DETECTORS = D.default_detectors(["Ann Lee"], ["fracture"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts)
def test_detection_and_masking(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string").withColumn(
        "types", D.info_types(F.col("t"), DETECTORS)
    )
    out = D.mask_column(df, "t", "m", "types", DETECTORS)
    out = out.withColumns(
        {
            "m2": D.mask_text(F.col("m"), DETECTORS),
            "left": D.info_types(F.col("m"), D.PATTERN_DETECTORS),
            "plain": D.mask_text(F.col("t"), DETECTORS),
        }
    )
    for r in out.collect():
        assert r.types == sorted(n for n, p in ORACLE.items() if p.search(r.t)), r.t
        assert r.m == r.plain
        if not r.left:
            assert r.m2 == r.m  # masking again changes nothing
        # what is left can only arise where a replacement joined two harmless pieces
        assert all(n not in ("FINANCIAL_ACCOUNT_NUMBER", "US_BANK_ROUTING_MICR") for n in r.left)


def test_large_dictionary_equals_pattern(spark, sf):
    """The join on digests of words finds what the pattern finds, broadcast or not."""
    from checks import base
    from promptlens.operators.deidentify import find_dictionary_terms
    from checks import telemetry as T

    texts = base.flat(spark, sf).select("insert_id", "prompt_text")
    terms = spark.createDataFrame([(n, "PERSON_NAME") for n in T.SUBJECT_NAMES], "term string, info_type string")
    want = {
        (r.insert_id, n) for r in texts.collect() for n in T.SUBJECT_NAMES
        if re.search(rf"\b{re.escape(n)}\b", r.prompt_text)
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = find_dictionary_terms(texts, "insert_id", "prompt_text", terms)
            assert {(r.insert_id, r.term) for r in found.collect()} == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
