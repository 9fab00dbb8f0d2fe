"""Sensitive-data detectors, masking rules and risk scoring as Column expressions.

Boundaries are written as ASCII look-arounds, not ``\\b``: the meaning of ``\\b``
beside accented letters differs between Java releases and other regex engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens import fixed_values as V

WORD = "A-Za-z0-9_"
START, END = f"(?<![{WORD}])", f"(?![{WORD}])"

MASK_SSN, MASK_ACCOUNT, REPLACE, KEEP = "mask_ssn", "mask_account", "replace", "keep"


def at_word_start(first: str) -> str:
    """One character class or letter that must not follow a word character.

    The look-behind stands after the character, so that the engine runs it only where
    the character fits: several times faster on long texts than a leading one.
    """
    return f"{first}(?<![{WORD}].)"


@dataclass(frozen=True)
class MaskCharacters:
    """Masks the first ``count`` characters of each match (all where None); those in ``skip`` stay and don't count."""

    count: int | None = None
    mask: str = "*"
    skip: str = ""


@dataclass(frozen=True)
class Detector:
    """One row of the detector table.

    Every match contains one of the plain substrings ``needles``; texts without any
    skip the regex, which costs several times more. ``reported_as`` is the information
    type that findings carry. With ``ignore_case`` pattern and needles are lower case.
    """

    name: str
    pattern: str
    likelihood: str = "LIKELY"
    transform: str | MaskCharacters = REPLACE
    reported_as: str | None = None
    needles: tuple[str, ...] = ()
    ignore_case: bool = False

    @property
    def info_type(self) -> str:
        return self.reported_as or self.name

    def found(self, text: Column, low: Column | None = None) -> Column:
        """``low`` is the text in lower case, where a caller has it: each use of an expression may compute it again."""
        text = (F.lower(text) if low is None else low) if self.ignore_case else text
        return self.may_hold(text) & text.rlike(self.pattern)

    def may_hold(self, text: Column) -> Column:
        return reduce(lambda a, b: a | b, (text.contains(n) for n in self.needles), F.lit(not self.needles))


# Beyond this size one regex pass is cheaper than a substring test per term.
MAX_NEEDLES = 24


def _dictionary(name: str, terms: Iterable[str], likelihood: str, how: str, ignore_case: bool) -> Detector:
    """Literal terms as whole words, longest first."""
    terms = sorted(set(terms), key=lambda t: (-len(t), t))
    pattern = f"{START}(?:{'|'.join(re.escape(t) for t in terms)}){END}"
    needles = tuple(terms) if len(terms) <= MAX_NEEDLES else ()
    return Detector(name, pattern, likelihood, how, needles=needles, ignore_case=ignore_case)


# Clinical and injury terms of the default medical dictionary.
MEDICAL_TERMS = (
    "arthritis", "asthma", "bursitis", "concussion", "crush injury", "dermatitis", "diabetes", "epilepsy",
    "herniation", "hypertension", "migraine", "sciatica", "sprain", "tinnitus",
)


def person_names(names: Sequence[str], likelihood: str = "LIKELY") -> Detector:
    """Literal match of known subjects."""
    return _dictionary(V.PERSON, names, likelihood, REPLACE, ignore_case=False)


def medical_terms(terms: Sequence[str] = MEDICAL_TERMS, likelihood: str = "LIKELY") -> Detector:
    """Case-insensitive clinical terms: reported, but kept in the text."""
    return _dictionary(V.MEDICAL, (t.lower() for t in terms), likelihood, KEEP, ignore_case=True)


def custom(info_type: str, regex: str, likelihood: str = "LIKELY", transform: str | MaskCharacters = REPLACE) -> Detector:
    """User-added detector; each of its matches is replaced by the type, masked by characters, or kept."""
    if likelihood not in V.LIKELIHOODS:
        raise ValueError(f"unknown likelihood {likelihood!r}")
    if transform not in (REPLACE, KEEP) and not isinstance(transform, MaskCharacters):
        raise ValueError(f"unknown transform {transform!r}: replace, keep or MaskCharacters")
    return Detector(info_type, regex, likelihood, transform)


#: Terms of a dictionary table that become one pattern at most.
MOST_TERMS = 20_000


def dictionary_detectors(terms: DataFrame) -> tuple[Detector, ...]:
    """Detectors for a dictionary kept as a table (term, info_type), of any number of words; medical terms are
    kept in the text, all others masked. A pattern is for small tables: one of more than ``MOST_TERMS`` rows
    goes to ``deidentify(terms=...)``, which masks the same by joins, whatever the size.
    """
    rows = terms.select("term", "info_type").where("term != ''").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: give the table to deidentify(terms=...)")
    by_type: dict[str, list[str]] = {}
    for r in rows:
        by_type.setdefault(r["info_type"], []).append(r["term"])
    return tuple(
        medical_terms(found) if name == V.MEDICAL else _dictionary(name, found, "LIKELY", REPLACE, ignore_case=False)
        for name, found in sorted(by_type.items())
    )


_DIGIT = at_word_start("[0-9]")
REAL_SSN = Detector(
    V.SSN, at_word_start("[0-8]") + "[0-9]{2}(?<!000|666)-[0-9]{2}-[0-9]{4}" + END,
    "LIKELY", MASK_SSN, needles=("-",),
)
SYNTHETIC_SSN = Detector(
    V.SYNTHETIC_SSN, at_word_start("0") + "00-[0-9]{2}-[0-9]{4}" + END,
    "VERY_LIKELY", MASK_SSN, reported_as=V.SSN, needles=("000-",),
)
ACCOUNT = Detector(V.ACCOUNT, "Acct #[0-9]{10}" + END, "LIKELY", MASK_ACCOUNT, needles=("Acct #",))
ROUTING = Detector(V.ROUTING, "Routing #[0-9]{9}" + END, "LIKELY", REPLACE, needles=("Routing #",))
DOB = Detector(V.DOB, _DIGIT + "[0-9]/[0-9]{2}/[0-9]{4}" + END, "POSSIBLE", REPLACE, needles=("/",))
EMAIL = Detector(
    V.EMAIL,
    at_word_start(f"[{WORD}]") + r"[A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + END,
    "LIKELY", REPLACE, needles=("@",),
)

# Masking follows the order of this table: SSN, account, routing, date, email;
# dictionaries come last. Earlier replacements are never seen by later rules.
PATTERN_DETECTORS = (REAL_SSN, SYNTHETIC_SSN, ACCOUNT, ROUTING, DOB, EMAIL)


def default_detectors(names: Sequence[str] = (), terms: Sequence[str] = MEDICAL_TERMS) -> tuple[Detector, ...]:
    people = (person_names(names),) if names else ()
    return PATTERN_DETECTORS + people + (medical_terms(terms),)


def min_likelihood(detectors: Sequence[Detector], level: str = "POSSIBLE") -> tuple[Detector, ...]:
    floor = V.LIKELIHOODS.index(level)
    return tuple(d for d in detectors if V.LIKELIHOODS.index(d.likelihood) >= floor)


def info_types(text: Column, detectors: Sequence[Detector], low: Column | None = None) -> Column:
    """Sorted distinct information types found in a text (types only, no quotes). ``low`` as in :meth:`Detector.found`."""
    by_type: dict[str, list[Detector]] = {}
    for d in detectors:
        by_type.setdefault(d.info_type, []).append(d)
    found = [
        F.when(reduce(lambda a, b: a | b, (d.found(text, low) for d in by_type[name])), name).otherwise("")
        for name in sorted(by_type)
    ]
    return F.array_remove(F.array(*found), "") if found else F.array().cast("array<string>")


def contains_type(types: Column, name: str) -> Column:
    return F.array_contains(types, name)


def contains_any(types: Column, *names: str) -> Column:
    return reduce(lambda a, b: a | b, (contains_type(types, n) for n in names))


def is_toxic(types: Column) -> Column:
    return contains_type(types, V.SSN) & contains_any(types, V.MEDICAL, V.ACCOUNT, V.ROUTING)


def risk_level(types: Column) -> Column:
    """NONE, CRITICAL (toxic), HIGH (SSN, medical, bank), MEDIUM (birth date), else LOW."""
    return (
        F.when(F.size(types) == 0, "NONE")
        .when(is_toxic(types), "CRITICAL")
        .when(contains_any(types, V.SSN, V.MEDICAL, V.ACCOUNT, V.ROUTING), "HIGH")
        .when(contains_type(types, V.DOB), "MEDIUM")
        .otherwise("LOW")
    )


def is_shadow(department: Column, types: Column) -> Column:
    return F.coalesce((department == "Operations") & contains_type(types, V.SSN), F.lit(False))


def mask_chars(value: Column, count: int | None, mask: str = "*", skip: str = "") -> Column:
    """Mask the first ``count`` characters of a whole value (all where None); characters in
    ``skip`` stay and do not count."""
    kept = f"[^{re.escape(skip)}]" if skip else r"[\s\S]"
    skipped = f"[{re.escape(skip)}]*" if skip else ""
    times = "*" if count is None else f"{{0,{count}}}"
    prefix = F.regexp_extract(value, f"^((?:{skipped}{kept}){times})", 1)
    return F.concat(
        F.regexp_replace(prefix, kept, mask.replace("\\", r"\\").replace("$", r"\$")),
        value.substr(F.length(prefix) + 1, F.length(value)),
    )


_SSN_SPAN = at_word_start("[0-8]") + "[0-9]{2}(?<!666)-[0-9]{2}-([0-9]{4})" + END
_ACCOUNT_SPAN = "(Acct #)[0-9]{6}([0-9]{4})" + END
_ROUTING_SPAN = "(Routing #)[0-9]{9}" + END


def mask_ssn(text: Column, style: str = "plain") -> Column:
    to = "***-**-$1" if style == "plain" else "[US_SSN: ***-**-$1]"
    return F.regexp_replace(text, _SSN_SPAN, to)


def mask_account(text: Column, style: str = "plain") -> Column:
    to = "$1******$2" if style == "plain" else "$1[BANK_ACCT: ******$2]"
    return F.regexp_replace(text, _ACCOUNT_SPAN, to)


def replace_with_type(text: Column, detector: Detector) -> Column:
    if detector.name == V.ROUTING:
        return F.regexp_replace(text, _ROUTING_SPAN, f"$1[{V.ROUTING}]")
    flags = "(?i)" if detector.ignore_case else ""
    return F.regexp_replace(text, flags + detector.pattern, f"[{detector.info_type}]")


def each_match(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of a pattern changed by an expression of its own."""
    between = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), change)
    pieces = F.zip_with(between, matches, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def transform(text: Column, detector: Detector, style: str = "plain") -> Column:
    """A detector's transform of a text."""
    if isinstance(detector.transform, MaskCharacters):
        rule = detector.transform
        pattern = ("(?i)" if detector.ignore_case else "") + detector.pattern
        return each_match(text, pattern, lambda m: mask_chars(m, rule.count, rule.mask, rule.skip))
    if detector.transform == MASK_SSN:
        return mask_ssn(text, style)
    if detector.transform == MASK_ACCOUNT:
        return mask_account(text, style)
    if detector.transform not in (REPLACE, KEEP):
        raise ValueError(f"unknown transform {detector.transform!r}")
    return replace_with_type(text, detector) if detector.transform == REPLACE else text


def masking_rules(detectors: Sequence[Detector], style: str = "plain") -> list[Detector]:
    """Detectors that change text, in table order; one rule masks both kinds of SSN."""
    if style not in ("plain", "tagged"):
        raise ValueError(f"unknown mask style {style!r}")
    rules, seen = [], set()
    for d in detectors:
        once = d.info_type if d.transform == MASK_SSN else d
        if d.transform != KEEP and once not in seen:
            rules.append(d)
            seen.add(once)
    return rules


def mask_text(text: Column, detectors: Sequence[Detector], style: str = "plain") -> Column:
    """Apply every detector's transform in table order, as one expression."""
    rules = masking_rules(detectors, style)
    if len(rules) == 1:
        return F.when(rules[0].found(text), transform(text, rules[0], style)).otherwise(text)
    return reduce(lambda t, d: transform(t, d, style), rules, text)


def mask_column(df: DataFrame, source: str, target: str, types: str, detectors: Sequence[Detector], style: str = "plain") -> DataFrame:
    """Mask a text column whose information types are known.

    Each rule is a step of its own and runs only on rows where its type was found, so
    clean texts cost nothing.
    """
    df = df.withColumn(target, F.col(source))
    for rule in masking_rules(detectors, style):
        text = F.col(target)
        hit = contains_type(F.col(types), rule.info_type)
        df = df.withColumn(target, F.when(hit, transform(text, rule, style)).otherwise(text))
    return df
