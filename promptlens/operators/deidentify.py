"""Inspection and de-identification of the three-field record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions.hashing import DIGITS, ActorKey, actor_hash, email_digest
from promptlens.operators.dictionary import mask_terms

# Words of a dictionary term; possessive endings of the last one are left out.
WORD_START = r"(?<![\p{L}0-9_])"
A_WORD = r"\p{L}+(?:['-]\p{L}+)*"
LAST_WORD = r"\p{L}+(?:['-]\p{L}{2,})*"
#: Terms of a dictionary that is sent to every task; a larger one is shuffled.
SENT_TERMS = 50_000


def inspect(df: DataFrame, detectors: Sequence[D.Detector], text: str = "prompt_text", min_likelihood: str = "POSSIBLE") -> DataFrame:
    """Add the sorted distinct information types of a text column."""
    chosen = D.min_likelihood(detectors, min_likelihood)
    lowered = df.withColumn("_low", F.lower(text))  # a step of its own, so that it is computed once
    return lowered.withColumn("dlp_info_types", D.info_types(F.col(text), chosen, F.col("_low"))).drop("_low")


def finding_flags(df: DataFrame) -> DataFrame:
    """Flags, counts and risk that follow from the found types."""
    types = F.col("dlp_info_types")
    return df.withColumns(
        {
            "dlp_detected": F.size(types) > 0,
            "dlp_risk_level": D.risk_level(types),
            "dlp_finding_count": F.size(types).cast("bigint"),
            "contains_ssn": D.contains_type(types, V.SSN),
            "contains_medical_phi": D.contains_type(types, V.MEDICAL),
            "contains_financial_acct": D.contains_type(types, V.ACCOUNT),
            "is_toxic_combination": D.is_toxic(types),
            "is_shadow_prompt": D.is_shadow(F.col("department"), types),
        }
    )


def deidentify(
    df: DataFrame, detectors: Sequence[D.Detector], key: ActorKey, style: str = "plain", min_likelihood: str = "POSSIBLE",
    digits: int = DIGITS, terms: DataFrame | None = None,
) -> DataFrame:
    """Redact the name, hash the email and mask the prompt in one narrow pass.

    Expects ``employee_name, employee_email, prompt_text``; gives
    ``employee_name`` (emptied), ``employee_email`` (base64 digest),
    ``anonymous_actor_hash``, ``prompt_text_masked`` and ``dlp_info_types``.
    The raw prompt is gone. ``digits`` is the length of actor ids. ``terms`` (term, info_type) is a dictionary of any
    size, found and masked after the detectors by joins; only keyed digests and ciphertext move for it.
    """
    email = F.col("employee_email")
    found = inspect(df, detectors, min_likelihood=min_likelihood)
    hashed = found.withColumns(
        {
            "employee_name": F.lit(""),
            "employee_email": email_digest(email, key),
            "anonymous_actor_hash": actor_hash(email, key, digits),
        }
    )
    chosen = D.min_likelihood(detectors, min_likelihood)
    masked = D.mask_column(hashed, "prompt_text", "prompt_text_masked", "dlp_info_types", chosen, style)
    return masked.drop("prompt_text") if terms is None else mask_terms(masked, terms, key)


def pseudonymise(df: DataFrame) -> DataFrame:
    """Only the actor id stays: the emptied name and the full digest are dropped."""
    return df.drop("employee_name", "employee_email")


def find_dictionary_terms(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """Dictionaries kept as a table: terms of any number of words found in texts by an equi-join.

    ``terms`` is (term, info_type), matched as whole words that single spaces separate, ignoring case for
    medical terms. Returns (id, term, info_type), distinct. What moves between executors are digests of
    runs of words, as long as the dictionary's terms are, never the words; runs are distinct per
    text, and a very common one is split by the skew join. Up to ``SENT_TERMS`` terms are broadcast; the texts'
    runs never are, however small the plan takes them for.
    """
    folded = F.when(F.col("info_type") == V.MEDICAL, F.lower("term")).otherwise(F.col("term"))
    known = terms.select("term", "info_type", folded.alias("key"), F.size(F.split("term", " ")).alias("words")).distinct()
    sizes = {r["words"]: r["count"] for r in known.groupBy("words").count().collect()}
    lengths = sorted(sizes)  # word counts of terms
    if not lengths:
        return df.select(id_col, F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("info_type")).limit(0)
    known = known.withColumn("digest", F.sha2("key", 256)).drop("key", "words")
    known = known.hint("broadcast" if sum(sizes.values()) <= SENT_TERMS else "merge")
    text = F.col(text_col)
    runs = []
    for n in lengths:
        if n == 1:
            runs.append(F.regexp_extract_all(text, F.lit(f"{WORD_START}({LAST_WORD})"), 1))
        else:
            rule = F.lit(f"{WORD_START}({A_WORD})(?=((?: {A_WORD}){{{n - 2}}} {LAST_WORD}))")
            runs.append(F.zip_with(F.regexp_extract_all(text, rule, 1), F.regexp_extract_all(text, rule, 2), lambda a, b: F.concat(a, b)))
    every = F.flatten(F.array(*runs))
    digests = F.transform(F.array_distinct(F.concat(every, F.transform(every, F.lower))), lambda w: F.sha2(w, 256))
    found = df.select(id_col, F.explode(digests).alias("digest")).join(known, "digest")
    return found.select(id_col, "term", "info_type").distinct()
