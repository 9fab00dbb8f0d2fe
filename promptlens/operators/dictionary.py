"""Dictionaries of any size, kept as tables: their terms found, flagged and masked in texts by joins.

A text is cut into tokens, words of letters, digits and underscores and single other characters. A term is a run of
tokens that no word character touches, as in the pattern form. What moves between executors is de-identified: keyed digests of
runs, places, and the texts themselves as ciphertext.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions.detectors import WORD
from promptlens.functions.hashing import ActorKey

TOKEN = f"[{WORD}]+|[^{WORD}]"
#: First tokens of terms that are told apart before runs are built; of more, every run is.
MOST_STARTS = 10_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _is_word(token: Column) -> Column:
    return token.rlike(f"^[{WORD}]")


def _digest(pad: Column, run: Column, folded: bool) -> Column:
    """Keyed digest of a run of tokens, apart for terms that ignore case."""
    run = F.lower(run) if folded else run
    return F.substring(F.unhex(F.sha2(F.concat(pad, F.lit(b"i" if folded else b"c"), run.cast("binary")), 256)), 1, 16)


def _start(pad: Column, token: Column, folded: bool) -> Column:
    """Keyed hash of a term's first token."""
    return F.xxhash64(pad, F.lit(b"i" if folded else b"c"), token)


def _starts(terms: DataFrame, pad: Column, folds: list[bool]) -> dict[bool, list[int] | None]:
    """Hashes of the terms' first tokens, of those that ignore case and the others; None for too many."""
    out: dict[bool, list[int] | None] = {}
    for folded in folds:
        some = terms.where((F.col("info_type") == V.MEDICAL) == F.lit(folded))
        first = F.get(tokens(F.lower("term") if folded else F.col("term")), F.lit(0))
        rows = some.select(_start(pad, first, folded).alias("h")).distinct().limit(MOST_STARTS + 1).collect()
        out[folded] = [r["h"] for r in rows] if len(rows) <= MOST_STARTS else None
    return out


def _may_start(pad: Column, token: Column, starts: dict[bool, list[int] | None]) -> Column:
    """Whether a term may begin with a token. Case beyond ASCII may depend on what follows: such a token passes where case is ignored."""
    may = F.lit(False)
    for folded, known in starts.items():
        if known is None:
            return F.lit(True)
        hit = _start(pad, F.lower(token) if folded else token, folded).isin(known)
        may = may | (hit | token.rlike("[^\\x00-\\x7F]") if folded else hit)
    return may


def _runs(tokens: Column, words: Column, begin: Column, lengths: list[int], spaced: bool, placed: bool) -> Column:
    """(at, n, run) of every run of tokens that may be a term; ``words`` tells words from other tokens, ``begin`` those that
    a term may begin with, ``at`` is 0 where only the finding counts."""
    size, no = F.size(tokens), F.lit(False)

    def runs(n: int) -> Column:
        starts = F.filter(begin, lambda i: i <= size - n + 1)

        def may_be(i: Column) -> Column:
            first, last, before, after = (F.get(words, i + k) for k in (-1, n - 2, -2, n - 1))
            apart = (first | ~F.coalesce(before, no)) & (last | ~F.coalesce(after, no))
            return apart if spaced else apart & (first | (F.trim(F.get(tokens, i - 1)) != ""))

        def as_run(i: Column) -> Column:
            run = F.get(tokens, i - 1) if n == 1 else F.array_join(F.slice(tokens, i, F.lit(n)), "")
            return F.struct((i if placed else F.lit(0)).alias("at"), F.lit(n).alias("n"), run.alias("run"))

        return F.transform(F.filter(starts, may_be), as_run)

    every = F.flatten(F.array(*map(runs, lengths)))
    return every if placed else F.array_distinct(every)


def _chosen(found: Column) -> Column:
    """Spans to be masked: type after type in the order of their names, each from left to right, the longest first."""
    order = F.transform(F.filter(found, lambda s: (s["at"] > 0) & (s["info_type"] != V.MEDICAL)), lambda s: F.struct(s["info_type"].alias("info_type"), s["at"].alias("at"), (-s["n"]).alias("n")))
    start = F.struct(F.lit(None).cast("string").alias("info_type"), F.lit(0).alias("end"), F.filter(order, lambda s: F.lit(False)).alias("taken"))

    def step(state: Column, s: Column) -> Column:
        end = s["at"] - s["n"]
        free = ~F.coalesce(s["info_type"] == state["info_type"], F.lit(False)) | (s["at"] >= state["end"])
        others = F.exists(state["taken"], lambda t: (t["info_type"] != s["info_type"]) & (t["at"] < end) & (s["at"] < t["at"] - t["n"]))
        take = free & ~others
        same = F.coalesce(s["info_type"] == state["info_type"], F.lit(False))
        return F.struct(
            s["info_type"].alias("info_type"), F.when(take, end).when(same, state["end"]).otherwise(0).alias("end"),
            F.when(take, F.concat(state["taken"], F.array(s))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(F.array_sort(order), start, step, lambda state: state["taken"])


def _rebuilt(tokens: Column, spans: Column) -> Column:
    """The text with each span replaced by its type."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["info_type"].alias("info_type"))))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def piece(a: Column, b: Column) -> Column:
        return F.array_join(F.slice(tokens, a, b - a), "")

    def step(state: Column, s: Column) -> Column:
        out = F.concat(state["out"], piece(state["at"], s["at"]), F.lit("["), s["info_type"], F.lit("]"))
        return F.struct(out.alias("out"), (s["at"] - s["n"]).alias("at"))

    return F.aggregate(by_place, start, step, lambda state: F.concat(state["out"], piece(state["at"], F.size(tokens) + 1)))


def mask_terms(df: DataFrame, terms: DataFrame, key: ActorKey, raw: str = "prompt_text", masked: str = "prompt_text_masked", types: str = "dlp_info_types") -> DataFrame:
    """Add the types of a dictionary's terms found in ``raw`` to ``types``, and mask the terms in ``masked``; ``raw`` goes.

    ``terms`` is (term, info_type), of any number of rows. Medical terms ignore case and stay in the text; of the others each
    occurrence, the longest from the left, becomes its ``[info_type]``; where spans of two types overlap, the type that
    comes first by name is masked; what touches a term is what stands there before any term is masked. The rows are read twice: for the runs that are joined, and for the texts. Null texts
    stay null; empty terms are left out; without terms only ``raw`` goes. A common run of tokens, and a text that
    many rows hold, are split by the skew join.
    """
    terms = terms.where("term != '' and info_type is not null")
    folded = F.col("info_type") == V.MEDICAL
    length = F.size(tokens(F.col("term")))
    # token counts of terms, as few as the longest term is long
    shape = terms.groupBy(length.alias("n"), folded.alias("folded")).agg(F.max(F.substring("term", 1, 1) == " ").alias("spaced")).collect()
    if not shape:
        return df.drop(raw)
    lengths, folds = sorted({r["n"] for r in shape}), sorted({r["folded"] for r in shape})
    spaced = any(r["spaced"] for r in shape)
    pad, _ = key.pads()
    of = F.when(folded, _digest(pad, F.col("term"), True)).otherwise(_digest(pad, F.col("term"), False))
    known = terms.select(of.alias("digest"), "info_type").distinct()
    keyed = df.withColumn("_text_key", F.substring(F.unhex(F.sha2(F.concat(pad, F.lit(b"t"), F.col(raw).cast("binary")), 256)), 1, 16))
    # through a generator, so that a text is cut once and not in every step over its tokens
    both = F.inline(F.array(F.struct(tokens(F.col(masked)).alias("_tokens"), F.when(F.col(raw) != F.col(masked), tokens(F.col(raw))).alias("_raw_tokens"))))
    cut = keyed.where(F.col(masked).isNotNull()).select("_text_key", pad.alias("_pad"), both)
    starts = _starts(terms, pad, folds)

    def begin(c: str) -> Column:
        return F.filter(F.transform(c, lambda t, i: F.when(_may_start(F.col("_pad"), t, starts), i + 1)), lambda i: i.isNotNull())

    both = [x for c in ("_tokens", "_raw_tokens") for x in (F.transform(c, _is_word).alias(f"{c}_words"), begin(c).alias(f"{c}_begin"))]
    cut = cut.select("*", F.inline(F.array(F.struct(*both))))
    cut = cut.where((F.size("_tokens_begin") > 0) | (F.size("_raw_tokens_begin") > 0))
    own = _runs(F.col("_tokens"), F.col("_tokens_words"), F.col("_tokens_begin"), lengths, spaced, True)
    also = F.when(F.col("_raw_tokens").isNotNull(), _runs(F.col("_raw_tokens"), F.col("_raw_tokens_words"), F.col("_raw_tokens_begin"), lengths, spaced, False))
    spans = cut.select("_text_key", F.explode(F.array(own, also)).alias("_runs")).select("_text_key", F.inline("_runs"))
    digests = F.explode(F.array(*(_digest(pad, F.col("run"), f) for f in folds))).alias("digest")
    spans = spans.select("_text_key", "at", "n", digests)
    found = spans.join(known, "digest").groupBy("_text_key").agg(F.collect_set(F.struct("info_type", "at", "n")).alias("_found"))
    secret = F.unhex(F.sha2(F.concat(pad, F.lit(b"s")), 256))
    sealed = keyed.withColumn("_changed", F.coalesce(F.col(raw) != F.col(masked), F.lit(False))).withColumn(masked, F.aes_encrypt(F.col(masked).cast("binary"), secret)).drop(raw)
    joined = sealed.join(found, "_text_key", "left").withColumn(masked, F.aes_decrypt(masked, secret).cast("string"))
    # where masks came before, the raw text says what was there and the masked one where it still is
    found = F.filter("_found", lambda s: (s["at"] == 0) | ~F.col("_changed"))
    there = F.transform(found, lambda s: s["info_type"])
    new_types = F.array_sort(F.array_union(types, there))
    spans = _chosen(F.filter("_found", lambda s: F.array_contains(there, s["info_type"])))
    out = joined.withColumn(types, F.coalesce(new_types, F.col(types))).withColumn("_spans", F.when(F.col("_found").isNotNull(), spans))
    out = out.select("*", F.inline(F.array(F.struct(F.when(F.size("_spans") > 0, tokens(F.col(masked))).alias("_tokens")))))
    text = F.when(F.col("_tokens").isNotNull(), _rebuilt(F.col("_tokens"), F.col("_spans"))).otherwise(F.col(masked))
    return out.withColumn(masked, text).select(*(c for c in df.columns if c != raw))
