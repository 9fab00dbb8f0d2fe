"""Actor pseudonyms: keyed HMAC-SHA256 and salted SHA-256, as native expressions."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens import fixed_values as V

BLOCK = 64
KEY_SCHEMA = "key_id string, inner_pad binary, outer_pad binary"


def derive_key(seed: str | None = None) -> bytes:
    """32-byte key: SHA-256 of the seed, or random bytes where no seed is given."""
    return hashlib.sha256(seed.encode()).digest() if seed else secrets.token_bytes(32)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def key_table(spark: SparkSession, key: bytes, key_id: str = "default") -> DataFrame:
    """One-row key table. Production keys are written once to a restricted path
    and read back with ``spark.read``; see :class:`ActorKey`."""
    inner, outer = _pads(key)
    return spark.createDataFrame([(key_id, bytearray(inner), bytearray(outer))], KEY_SCHEMA)


class ActorKey:
    """An HMAC key that reaches the plan as a scalar subquery over its table.

    The key is neither a literal (it would print in ``explain`` and event logs)
    nor a join side (no join is needed for one row). A query fails unless the table holds
    exactly one row of that id: without a key there would be no actors.
    """

    def __init__(self, table: DataFrame, key_id: str = "default"):
        found = table.where(F.col("key_id") == key_id).agg(
            F.count("*").alias("n"), F.min("inner_pad").alias("inner_pad"), F.min("outer_pad").alias("outer_pad")
        )
        wrong = F.raise_error(F.concat(F.lit(f"key {key_id}: "), F.col("n").cast("string"), F.lit(" rows instead of one"))).cast("binary")
        self._row = found.select(*(F.when(F.col("n") == 1, F.col(c)).otherwise(wrong).alias(c) for c in ("inner_pad", "outer_pad")))

    def pads(self) -> tuple[Column, Column]:
        return self._row.select("inner_pad").scalar(), self._row.select("outer_pad").scalar()


def hmac_sha256(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """HMAC-SHA256 of a text as 32 bytes, equal to the RFC 2104 construction."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer_pad, inner), 256))


DIGITS = 8  # of an actor id; 16 keep billions of actors apart


def format_actor_hash(digest_b64: Column, digits: int = DIGITS) -> Column:
    """'usr_' + first ``digits`` hex digits of a base64 digest.

    Empty gives the anonymous actor. Characters outside the base64 alphabet are
    ignored; text that still does not decode keeps as many first alphanumerics in
    lower case.
    """
    alphabet = F.regexp_replace(digest_b64, "[^0-9A-Za-z+/=]", "")
    whole = F.when(F.length(alphabet) % 4 == 0, alphabet)
    decoded = F.lower(F.hex(F.try_to_binary(whole, F.lit("base64"))))
    plain = F.lower(F.regexp_replace(digest_b64, "[^0-9A-Za-z]", ""))
    return F.when(is_empty(digest_b64), V.ANONYMOUS_ACTOR).otherwise(
        F.concat(F.lit(V.ACTOR_PREFIX), F.substring(F.coalesce(decoded, plain), 1, digits))
    )


def is_empty(email: Column) -> Column:
    return F.coalesce(email, F.lit("")) == ""


def email_digest(email: Column, key: ActorKey) -> Column:
    """Base64 HMAC of an email; '' where the email is empty or absent."""
    return F.when(is_empty(email), "").otherwise(F.base64(hmac_sha256(email, *key.pads())))


def actor_hash(email: Column, key: ActorKey, digits: int = DIGITS) -> Column:
    """Actor id of an email: what :func:`format_actor_hash` gives for its digest, without
    the detour over base64."""
    digest = F.lower(F.hex(hmac_sha256(email, *key.pads())))
    return F.when(is_empty(email), V.ANONYMOUS_ACTOR).otherwise(
        F.concat(F.lit(V.ACTOR_PREFIX), F.substring(digest, 1, digits))
    )


def salted_actor_hash(email: Column, domain: str = V.ACTOR_HASH_DOMAIN, digits: int = DIGITS) -> Column:
    """Unkeyed form: SHA-256 of the domain and the trimmed lower-case email."""
    digest = F.sha2(F.concat(F.lit(domain), F.lower(F.trim(email))), 256)
    return F.concat(F.lit(V.ACTOR_PREFIX), F.substring(digest, 1, digits))
