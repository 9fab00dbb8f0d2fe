"""Checked queries: detection, de-identification, hashing, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import DETECTORS, check, curated, entries, flat, joined, masked, test_key
from checks.telemetry_sql import sql
from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions import hashing as H
from promptlens.functions import sql as S
from promptlens.operators import audit as A
from promptlens.operators import deidentify as Deid
from promptlens.operators.curate import masked_rows
from promptlens.session import prepare
from checks import telemetry as T


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return flat(spark, sf).select("insert_id", "prompt_text", "department", "shift", "employee_email")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/documents.parquet")


# ---- detectors -----------------------------------------------------------------

@check(
    "d1_us_social_security_number",
    sql(
        "SELECT shift, department, count(*) AS texts, CAST(sum(CASE WHEN f_ssn AND shift = 'Shift 1' THEN 1 ELSE 0 END) AS BIGINT) AS found"
        " FROM masked GROUP BY ALL",
        upto="masked",
    ),
)
def real_ssn(spark: SparkSession, sf: str) -> DataFrame:
    """Areas 000, 666 and 9xx are not issued and not reported."""
    area = (
        F.when(F.col("shift") == "Shift 1", "123").when(F.col("shift") == "Shift 2", "666")
        .when(F.col("department") == "HR", "912").otherwise("000")
    )
    text = F.replace("prompt_text", F.lit("SSN: 000"), F.concat(F.lit("SSN: "), area))
    return _prompts(spark, sf).select("shift", "department", text.alias("text")).groupBy(
        "shift", "department"
    ).agg(F.count("*").alias("texts"), F.count_if(D.REAL_SSN.found(F.col("text"))).alias("found"))


def _register(name: str, detector: D.Detector, flag: str) -> None:
    @check(name, sql(f"SELECT insert_id, {flag} AS found FROM masked", upto="masked"))
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _prompts(spark, sf).select("insert_id", detector.found(F.col("prompt_text")).alias("found"))


_register("d2_synthetic_us_ssn", D.SYNTHETIC_SSN, "f_ssn")
_register("d3_email_address", D.EMAIL, "f_mail")
_register("d4_date_of_birth", D.DOB, "f_dob")
_register("d5_financial_account_number", D.ACCOUNT, "f_acct")
_register("d6_us_bank_routing_micr", D.ROUTING, "f_rout")
_register("d7_person_name", D.person_names(T.SUBJECT_NAMES), "f_name")
_register("d8_medical_term", D.medical_terms(), "f_med")


@check(
    "d3_email_in_documents",
    f"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') AS found FROM documents",
)
def email_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts in four languages."""
    return _documents(spark, sf).select("doc_id", D.EMAIL.found(F.col("text")).alias("found"))


@check(
    "d3_email_in_pages",
    "SELECT page_id, regexp_matches(html, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') AS found FROM pages",
)
def email_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = prepare(spark).read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", D.EMAIL.found(F.col("html")).alias("found"))


@check(
    "d7_dictionary_join",
    sql("SELECT insert_id, nam AS term, 'PERSON_NAME' AS info_type FROM masked WHERE f_name", upto="masked"),
)
def dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    """A name list kept as data and found by an equi-join on word pairs."""
    names = T.roster(  # the dictionary holds the subjects and every employee of the table
        T.read_events(spark, sf)
    ).select(F.col("employee_name").alias("term"))
    subjects = spark.createDataFrame([(n,) for n in T.SUBJECT_NAMES], "term string")
    terms = names.union(subjects).select("term", F.lit(V.PERSON).alias("info_type"))
    return Deid.find_dictionary_terms(_prompts(spark, sf), "insert_id", "prompt_text", terms)


@check(
    "d9_custom_detector",
    "SELECT doc_id, regexp_matches(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b') AS found FROM documents",
)
def custom_detector(spark: SparkSession, sf: str) -> DataFrame:
    octet = r"[0-9]{1,3}"
    address = D.custom("NETWORK_ADDRESS", D.START + r"\.".join([octet] * 4) + D.END, "POSSIBLE")
    found = D.info_types(F.col("text"), [address])
    return _documents(spark, sf).select("doc_id", D.contains_type(found, "NETWORK_ADDRESS").alias("found"))


@check("d9_mask_characters", sql("SELECT insert_id, regexp_replace(prompt_text, 'Lot #[0-9]{2}([0-9])\\b', '*** #**\\1', 'g') AS text FROM flat", upto="flat"))
def mask_characters(spark: SparkSession, sf: str) -> DataFrame:
    """A custom detector whose first five characters are masked, marks not counted."""
    lot = D.custom("LOT", "Lot #[0-9]{3}" + D.END, transform=D.MaskCharacters(5, "*", " #"))
    return _prompts(spark, sf).select("insert_id", D.mask_text(F.col("prompt_text"), [lot]).alias("text"))


def _many_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects and the clinical terms among a term for each order line, tens of thousands of them."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.format_string("Order %d Line %d", "l_orderkey", "l_linenumber").alias("term"), F.lit("ORDER").alias("info_type"))
    known = [(n, V.PERSON) for n in T.SUBJECT_NAMES] + [(t, V.MEDICAL) for t in D.MEDICAL_TERMS]
    return lines.union(spark.createDataFrame(known, "term string, info_type string"))


@check("d7_dictionary_of_any_size", sql("SELECT insert_id, prompt_text_masked FROM masked", upto="masked"))
def large_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary too large for a pattern, masked by joins on keyed digests."""
    out = masked_rows(entries(spark, sf), D.PATTERN_DETECTORS, test_key(spark), terms=_many_terms(spark, sf))
    return out.select("insert_id", "prompt_text_masked")


@check("d8_dictionary_of_any_size", sql("SELECT insert_id, array_to_string(info_types, ',') AS types, f_med AS medical, is_toxic_combination AS toxic FROM masked", upto="masked"))
def large_dictionary_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Types, flags and risk follow from the joined terms; medical ones ignore case and stay in the text."""
    out = masked_rows(entries(spark, sf), D.PATTERN_DETECTORS, test_key(spark), terms=_many_terms(spark, sf))
    return out.select("insert_id", joined("dlp_info_types", "types"), F.col("contains_medical_phi").alias("medical"), F.col("is_toxic_combination").alias("toxic"))


# --- fixed values: a dictionary of terms of one to three words ---
TERMS = [("filler", "MACHINE"), ("label scanner script", "SOFTWARE"), ("syrup yield", "FIGURE"), ("crush injury", "MEDICAL_TERM")]


@check(
    "d8_dictionary_masks",
    sql(
        "SELECT insert_id, regexp_replace(regexp_replace(regexp_replace(prompt_text, '\\bfiller\\b', '[MACHINE]', 'g'), '\\blabel scanner script\\b', '[SOFTWARE]', 'g'),"
        " '\\bsyrup yield\\b', '[FIGURE]', 'g') AS text, regexp_matches(prompt_text, '\\bcrush injury\\b') AS medical FROM flat",
        upto="flat",
    ),
)
def dictionary_masks(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary kept as a table, masked in the text; medical terms are reported and kept."""
    detectors = D.dictionary_detectors(spark.createDataFrame(TERMS, "term string, info_type string"))
    text = F.col("prompt_text")
    found = D.info_types(text, detectors)
    return _prompts(spark, sf).select("insert_id", D.mask_text(text, detectors).alias("text"), D.contains_type(found, V.MEDICAL).alias("medical"))


@check(
    "d10_min_likelihood",
    sql(
        "SELECT insert_id, coalesce(array_to_string(list_filter(info_types, lambda x: x <> 'DATE_OF_BIRTH'), ','), '') AS info_types FROM masked",
        upto="masked",
    ),
)
def likely_only(spark: SparkSession, sf: str) -> DataFrame:
    """At LIKELY the weaker date detector drops out."""
    return Deid.inspect(_prompts(spark, sf), DETECTORS, min_likelihood="LIKELY").select(
        "insert_id", joined("dlp_info_types", "info_types")
    )


@check(
    "d11_normalize_info_type",
    sql("SELECT t AS info_type, count(*) AS prompts FROM (SELECT unnest(info_types) AS t FROM masked) GROUP BY 1", upto="masked"),
)
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    return (
        Deid.inspect(_prompts(spark, sf), DETECTORS)
        .select(F.explode("dlp_info_types").alias("info_type"))
        .groupBy("info_type").agg(F.count("*").alias("prompts"))
    )


TYPES = "coalesce(array_to_string(info_types, ','), '')"


@check("d12_info_types", sql(f"SELECT insert_id, {TYPES} AS info_types FROM masked", upto="masked"))
def info_types(spark: SparkSession, sf: str) -> DataFrame:
    return Deid.inspect(_prompts(spark, sf), DETECTORS).select(
        "insert_id", joined("dlp_info_types", "info_types")
    )


@check(
    "d13_detected_and_count",
    sql("SELECT insert_id, len(info_types) > 0 AS dlp_detected, len(info_types)::BIGINT AS dlp_finding_count FROM masked", upto="masked"),
)
def detected(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select("insert_id", "dlp_detected", "dlp_finding_count")


@check(
    "d14_membership_flags",
    sql("SELECT insert_id, f_ssn AS contains_ssn, f_med AS contains_medical_phi, f_acct AS contains_financial_acct FROM masked", upto="masked"),
)
def flags(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select(
        "insert_id", "contains_ssn", "contains_medical_phi", "contains_financial_acct"
    )


@check("d15_risk_level", sql("SELECT insert_id, dlp_risk_level FROM masked", upto="masked"))
def risk(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select("insert_id", "dlp_risk_level")


@check("d16_toxic_combination", sql("SELECT insert_id, is_toxic_combination FROM masked", upto="masked"))
def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select("insert_id", "is_toxic_combination")


@check("d17_shadow_prompt", sql("SELECT insert_id, is_shadow_prompt FROM masked", upto="masked"))
def shadow(spark: SparkSession, sf: str) -> DataFrame:
    return masked(spark, sf).select("insert_id", "is_shadow_prompt")


# ---- hashing and masking -------------------------------------------------------


@check("d18_redact_field", sql("SELECT insert_id, 'User ' || user_id AS before, '' AS employee_name, hmac_hex AS employee_email FROM masked", upto="masked"))
def redact(spark: SparkSession, sf: str) -> DataFrame:
    rows = flat(spark, sf).withColumn("before", F.col("employee_name"))
    out = Deid.deidentify(rows, DETECTORS, test_key(spark))
    return out.select("insert_id", "before", "employee_name", F.lower(F.hex(F.unbase64("employee_email"))).alias("employee_email"))


@check("d19_hmac_sha256", sql("SELECT insert_id, hmac_hex FROM masked", upto="masked"))
def hmac(spark: SparkSession, sf: str) -> DataFrame:
    inner, outer = test_key(spark).pads()
    digest = H.hmac_sha256(F.col("employee_email"), inner, outer)
    return _prompts(spark, sf).select("insert_id", F.lower(F.hex(digest)).alias("hmac_hex"))


@check(
    "d20_format_actor_hash",
    sql(
        "SELECT insert_id, CASE shift WHEN 'Shift 1' THEN 'usr_anonymous' WHEN 'Shift 2' THEN 'usr_ab' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0')"
        " ELSE 'usr_' || left(hmac_hex, 8) END AS actor FROM masked",
        upto="masked",
    ),
)
def actor(spark: SparkSession, sf: str) -> DataFrame:
    """Empty, not base64, and a proper digest."""
    digest = H.email_digest(F.col("employee_email"), test_key(spark))
    number = F.regexp_extract("employee_email", "([0-9]+)", 1).cast("int")
    given = (
        F.when(F.col("shift") == "Shift 1", "")
        .when(F.col("shift") == "Shift 2", F.concat(F.lit("AB-"), F.lpad(number % 1000, 3, "0")))
        .otherwise(digest)
    )
    return _prompts(spark, sf).select("insert_id", H.format_actor_hash(given).alias("actor"))


@check(
    "d21_salted_actor_hash",
    sql("SELECT insert_id, 'usr_' || left(sha256('cme-ge-dlp-actor-domain-v1:' || employee_email), 8) AS actor FROM flat", upto="flat"),
)
def salted(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.upper("employee_email"), F.lit(" "))
    return _prompts(spark, sf).select("insert_id", H.salted_actor_hash(padded).alias("actor"))


@check(
    "d23_mask_chars",
    sql(
        "SELECT insert_id, '***-**-' || right(ssn, 4) AS ssn, '******' || right(acct, 4) AS account FROM masked WHERE f_ssn AND f_acct",
        upto="masked",
    ),
)
def mask_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Whole values: five characters but hyphens, and six characters."""
    text = F.col("prompt_text")
    values = _prompts(spark, sf).select(
        "insert_id",
        F.regexp_extract(text, "SSN: ([0-9-]+)", 1).alias("ssn"),
        F.regexp_extract(text, "Acct #([0-9]+)", 1).alias("account"),
    ).where("ssn <> '' AND account <> ''")
    return values.select(
        "insert_id", D.mask_chars(F.col("ssn"), 5, skip="-").alias("ssn"),
        D.mask_chars(F.col("account"), 6).alias("account"),
    )


@check(
    "d24_mask_ssn",
    sql("SELECT insert_id, regexp_replace(prompt_text, '000-[0-9]{2}-', '***-**-', 'g') AS text FROM flat", upto="flat"),
)
def mask_ssn(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select("insert_id", D.mask_ssn(F.col("prompt_text")).alias("text"))


@check(
    "d25_mask_account",
    sql("SELECT insert_id, regexp_replace(prompt_text, 'Acct #100020', 'Acct #******', 'g') AS text FROM flat", upto="flat"),
)
def mask_account(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select("insert_id", D.mask_account(F.col("prompt_text")).alias("text"))


@check(
    "d26_replace_with_info_type",
    sql(
        "SELECT insert_id, CASE WHEN f_name THEN replace(replace(replace(replace(prompt_text, mail, '[EMAIL_ADDRESS]'), nam, '[PERSON_NAME]'), dob, '[DATE_OF_BIRTH]'), '#' || rout, '#[US_BANK_ROUTING_MICR]') ELSE prompt_text END AS text FROM masked",
        upto="masked",
    ),
)
def replace_types(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("prompt_text")
    for d in (D.ROUTING, D.DOB, D.EMAIL, D.person_names(T.SUBJECT_NAMES)):
        text = D.replace_with_type(text, d)
    return _prompts(spark, sf).select("insert_id", text.alias("text"))


@check(
    "d26_mask_documents",
    "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[EMAIL_ADDRESS]', 'g')) AS text_md5 FROM documents",
)
def mask_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts masked; the digest keeps the result small."""
    text = D.mask_text(F.col("text"), [D.EMAIL])
    return _documents(spark, sf).select("doc_id", F.md5(text).alias("text_md5"))


@check("d27_keep_medical", sql("SELECT insert_id, contains(prompt_text_masked, injury) AS kept FROM masked WHERE f_med", upto="masked"))
def keep_medical(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.lit(False)
    for injury in T.INJURIES:
        kept = kept | F.col("prompt_text_masked").contains(injury)
    return masked(spark, sf).where("contains_medical_phi").select("insert_id", kept.alias("kept"))


@check(
    "d28_mask_tagged",
    sql(
        "SELECT insert_id, CASE WHEN f_name THEN replace(replace(replace(replace(replace(replace(prompt_text, ssn, '[US_SSN: ***-**-' || right(ssn, 4) || ']'),"
        " '#' || acct, '#[BANK_ACCT: ******' || right(acct, 4) || ']'), '#' || rout, '#[US_BANK_ROUTING_MICR]'), dob, '[DATE_OF_BIRTH]'), mail, '[EMAIL_ADDRESS]'), nam, '[PERSON_NAME]')"
        " ELSE prompt_text END AS text FROM masked",
        upto="masked",
    ),
)
def mask_tagged(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select(
        "insert_id", D.mask_text(F.col("prompt_text"), DETECTORS, "tagged").alias("text")
    )


@check(
    "d29_deidentify",
    sql(f"SELECT insert_id, '' AS employee_name, hmac_hex AS email_digest, prompt_text_masked, {TYPES} AS info_types FROM masked", upto="masked"),
)
def deidentify(spark: SparkSession, sf: str) -> DataFrame:
    out = Deid.deidentify(flat(spark, sf), DETECTORS, test_key(spark))
    return out.select(
        "insert_id", "employee_name", F.lower(F.hex(F.unbase64("employee_email"))).alias("email_digest"),
        "prompt_text_masked", joined("dlp_info_types", "info_types"),
    )


# ---- audits --------------------------------------------------------------------


@check(
    "d30_residual_pii_audit",
    sql(
        "SELECT info_type, count(*) AS remaining FROM (SELECT unnest(list_filter(info_types, lambda x: x NOT IN ('MEDICAL_TERM', 'PERSON_NAME'))) AS info_type"
        " FROM masked WHERE shift = 'Shift 2') GROUP BY 1",
        upto="masked",
    ),
)
def residual(spark: SparkSession, sf: str) -> DataFrame:
    """The masked table with the texts of one shift left unmasked: the audit names just those."""
    leaky = curated(spark, sf).alias("c").join(_prompts(spark, sf).select("insert_id", "prompt_text"), "insert_id")
    leaky = leaky.withColumn("prompt_text_masked", F.when(F.col("shift") == "Shift 2", F.col("prompt_text")).otherwise(F.col("prompt_text_masked")))
    return A.residual_pii_audit(leaky)


@check(
    "d30_residual_pii_by_state",
    "WITH hits AS (SELECT lang, regexp_matches(text, '[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') AS hit FROM documents)"
    " SELECT lang, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS raw_hits, 0 AS masked_hits FROM hits GROUP BY 1",
)
def residual_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Emails found in documents before and after masking, per language."""
    return (
        _documents(spark, sf)
        .select("lang", F.col("text"), D.mask_text(F.col("text"), [D.EMAIL]).alias("clean"))
        .groupBy("lang")
        .agg(
            F.count_if(D.EMAIL.found(F.col("text"))).alias("raw_hits"),
            F.count_if(D.EMAIL.found(F.col("clean"))).cast("int").alias("masked_hits"),
        )
    )


@check(
    "d31_actor_bijection_audit",
    sql(
        "SELECT count(DISTINCT employee_email) AS distinct_emails, count(DISTINCT left(hmac_hex, 8)) AS distinct_hashes,"
        " (SELECT count(*) FROM (SELECT left(hmac_hex, 8) FROM masked GROUP BY 1 HAVING count(DISTINCT employee_email) > 1)) AS colliding_hashes FROM masked",
        upto="masked",
    ),
)
def bijection(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _prompts(spark, sf).select(
        "employee_email", H.actor_hash(F.col("employee_email"), test_key(spark)).alias("anonymous_actor_hash")
    )
    return A.actor_bijection_audit(pairs)


@check(
    "d32_run_counters",
    sql(
        "SELECT count(*) AS total_rows, count(DISTINCT hmac_hex) AS unique_actors, count(*) FILTER (len(info_types) > 0) AS flagged_rows,"
        " count(*) FILTER (f_ssn) AS ssn_rows, count(*) FILTER (is_toxic_combination) AS toxic_rows FROM masked",
        upto="masked",
    ),
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    return A.run_counters(curated(spark, sf))


# ---- function surface ----------------------------------------------------------


@check(
    "uf1_scalar_functions",
    sql("SELECT 'usr_' || left(hmac_hex, 8) AS actor, dlp_risk_level, is_toxic_combination, count(*) AS n FROM masked GROUP BY ALL", upto="masked"),
)
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = Deid.deidentify(flat(spark, sf), DETECTORS, test_key(spark))
    types = F.col("dlp_info_types")
    return rows.select(
        H.format_actor_hash(F.col("employee_email")).alias("actor"),
        D.risk_level(types).alias("dlp_risk_level"),
        D.is_toxic(types).alias("is_toxic_combination"),
    ).groupBy("actor", "dlp_risk_level", "is_toxic_combination").agg(F.count("*").alias("n"))


@check(
    "uf1_sql_functions",
    sql(
        "SELECT leaf_agent, dlp_risk_level AS risk, is_toxic_combination AS toxic, count(*) AS n,"
        " round(count(*) FILTER (f_ssn) / count(*) * 100, 1)::DOUBLE AS ssn_pct FROM masked GROUP BY 1, 2, 3",
        upto="masked",
    ),
)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A report as SQL text over the curated table."""
    curated(spark, sf).createOrReplaceTempView("prompt_logs")
    S.register(spark)
    return spark.sql(
        "SELECT leaf_agent, score_dlp_risk(dlp_info_types) AS risk, is_toxic(dlp_info_types) AS toxic, count(*) AS n,"
        " round(try_divide(count_if(contains_ssn), count(*)) * 100, 1) AS ssn_pct FROM prompt_logs"
        " GROUP BY leaf_agent, score_dlp_risk(dlp_info_types), is_toxic(dlp_info_types)"
    )
