"""The five judge facets as Column expressions.

The rubric fixes classes, enumerations and the coaching rules. Cue words and
thresholds the rubric leaves open are our own choices and live here as data.
All patterns run on lower-case text and use consuming ASCII boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlens import fixed_values as V
from promptlens.functions.detectors import contains_any


def _any_of(phrases: Iterable[str]) -> str:
    return f"(?:^|[^a-z])({'|'.join(phrases)})(?:[^a-z]|$)"


class Cue:
    """Phrases (small patterns) looked for in lower-case text, as whole words.

    A text that holds none of the phrases' literal beginnings is never matched
    against the pattern: plain substring tests are several times cheaper.
    """

    def __init__(self, *phrases: str):
        self.pattern = _any_of(phrases)
        self.needles = sorted({self._literal(p) for p in phrases})

    @staticmethod
    def _literal(phrase: str) -> str:
        start = re.match(r"[a-z ]+", phrase).group()
        return start[:-1] if phrase[len(start):].startswith("?") else start

    def found(self, low: Column) -> Column:
        candidates = reduce(lambda a, b: a | b, (low.contains(n) for n in self.needles))
        return candidates & low.rlike(self.pattern)


# The first cue verb of the prompt decides the intent; without one it is a question.
INTENT_VERBS = {
    "generation_drafting": ["draft", "write", "generate", "create", "prepare", "compose"],
    "transformation_summary": ["summarize", "translate", "rewrite", "reformat", "rephrase"],
    "code_scripting": ["code", "debug", "program", "script", "refactor"],
    "data_extraction": ["extract", "parse", "pull", "tabulate"],
    "analytical_reasoning": [
        "analyze", "calculate", "compute", "compare", "model", "evaluate", "correlate",
        "reconcile", "forecast",
    ],
}
VERB_PATTERN = _any_of(v for verbs in INTENT_VERBS.values() for v in verbs)
DEEP = Cue(
    "root cause", "correlate", "tariff", "variance", "payback", "fault", "compliance", "forecast"
)
PERSONA = Cue("act as", "you are an?", "as a senior", "in the role of")
FORMAT = Cue(
    "markdown", "table", "json", "bullets?", "bullet points?", "checklist", "numbered list", "yaml"
)
CONSTRAINTS = Cue(
    "limit", "at most", "at least", "no more than", "within", "exclude", "must not", "do not",
    "fewer than",
)
PASTED = Cue("pasted", "attached", "following (?:data|log|rows)", "here is the (?:data|log)")
SYSTEMS = Cue("sharepoint", "servicenow", "jira", "sap", "workday", "confluence", "google drive")
INTERNAL = Cue(
    "line [0-9]", "lot", "plant", "shift", "tickets?", "sop", "polic(?:y|ies)", "payroll",
    "onboarding", "vendor", "supplier", "press", "capa", "scrap", "overtime", "operators?", "claim",
)
# Word counts are only compared with small numbers: the match ends after a few words.
_WORD, _GAP = r"[^ \t\r\n\f]", r"[ \t\r\n\f]"
THREE_WORDS, SIX_WORDS = (f"^{_GAP}*+(?:{_WORD}++{_GAP}++){{{n}}}{_WORD}" for n in (2, 5))

CONNECTOR_CORPUS = {
    "SharePoint_Manufacturing_SOPs": "product_docs",
    "ServiceNow_Plant_Tickets": "it_support",
    "Jira_Quality_CAPA": "product_docs",
    "SAP_ERP_Materials": "product_docs",
    "SAP_ERP_Financials": "sales_collateral",
    "Google_Drive_Finance_Q3": "sales_collateral",
    "SAP_ERP_Procurement": "sales_collateral",
    "SharePoint_Vendor_Contracts": "sales_collateral",
    "Workday_HR_Records": "hr_policy",
    "SharePoint_Union_Contracts": "hr_policy",
    "Workday_Payroll_Docs": "hr_policy",
    "Google_Drive_Garnishment_Orders": "hr_policy",
    "Google_Drive_Shift_Logs": "product_docs",
    "ServiceNow_HR_Case_Mgmt": "hr_policy",
    "Confluence_Safety_OSHA_Policies": "hr_policy",
}
PILLAR_CORPUS = {"Operations": "product_docs", "Finance": "sales_collateral", "HR": "hr_policy"}
# Procurement work counts as commercial material, whichever pillar runs it.
AGENT_CORPUS = {
    agent: "sales_collateral" if number == 3 else PILLAR_CORPUS[pillar]
    for number, agent, _, pillar, _, _ in V.AGENTS
}
CORPUS_TARGET = {
    "hr_policy": "Workday_HR_Records",
    "product_docs": "SharePoint_Manufacturing_SOPs",
    "sales_collateral": "SAP_ERP_Financials",
    "it_support": "ServiceNow_Plant_Tickets",
    "codebase": "2_Predictive_Maintenance_PLC_Agent",
    "unknown": "SharePoint_Manufacturing_SOPs",
}
ADVICE = {
    "persona_role": "state the role the assistant should take",
    "explicit_output_format": "name the output format",
    "scope_constraints": "limit length, time or scope",
    "enterprise_rag_connector": "query a connector that holds the internal records",
}
PII_ADVICE = "Refer to employee or claim ids instead of personal identifiers."


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Constant map lookup, keys with the same value tested together."""
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    expr = F.lit(None).cast("string") if default is None else default
    for value, keys in by_value.items():
        expr = F.when(key.isin(*keys), F.lit(value)).otherwise(expr)
    return expr


# ``low`` below is the masked prompt in lower case.


def first_verb(low: Column) -> Column:
    return F.regexp_extract(low, VERB_PATTERN, 1)


def functional_intent(verb: Column) -> Column:
    """Intent of the first cue verb; without one the prompt is a question."""
    verbs = {v: intent for intent, words in INTENT_VERBS.items() for v in words}
    return lookup(verb, verbs, F.lit("info_seeking_qa"))


def has_persona(low: Column) -> Column:
    return PERSONA.found(low)


def has_explicit_format(low: Column) -> Column:
    return FORMAT.found(low)


def has_constraints(low: Column) -> Column:
    return CONSTRAINTS.found(low)


def is_short(text: Column) -> Column:
    """Five words or fewer."""
    return ~text.rlike(SIX_WORDS)


def is_search_query_style(text: Column) -> Column:
    """Three to five words."""
    return is_short(text) & text.rlike(THREE_WORDS)


def maturity_level(short: Column, persona: Column, fmt: Column, constraints: Column) -> Column:
    """Level 1 for five words or fewer, level 3 from two of the three flags, else level 2."""
    flags = persona.cast("int") + fmt.cast("int") + constraints.cast("int")
    return F.when(short, V.LEVEL_1).when(flags >= 2, V.LEVEL_3).otherwise(V.LEVEL_2)


def task_complexity(intent: Column, low: Column, connectors: Column, search_style: Column) -> Column:
    deep = (intent == "analytical_reasoning") & DEEP.found(low)
    light = intent.isin("info_seeking_qa", "transformation_summary") & (F.size(connectors) < 2)
    return (
        F.when((intent == "code_scripting") | deep, "high")
        .when(search_style | light, "low")
        .otherwise("medium")
    )


def is_agent(leaf_agent: Column) -> Column:
    return (leaf_agent != V.NATIVE_CHAT_AGENT) & (leaf_agent != "")


def grounding_type(low: Column, connectors: Column, leaf_agent: Column) -> Column:
    return (
        F.when((F.size(connectors) > 0) | is_agent(leaf_agent) | SYSTEMS.found(low), V.GROUNDING_RAG)
        .when(PASTED.found(low), V.GROUNDING_PASTED)
        .otherwise(V.GROUNDING_NONE)
    )


def requires_enterprise_knowledge(low: Column, connectors: Column) -> Column:
    return (F.size(connectors) > 0) | INTERNAL.found(low)


def target_corpus(intent: Column, connectors: Column, leaf_agent: Column, department: Column) -> Column:
    """Code work, else the first connector, else the agent, else the department."""
    first = F.get(connectors, 0)
    by_department = lookup(department, PILLAR_CORPUS, F.lit("unknown"))
    return F.when(intent == "code_scripting", "codebase").otherwise(
        F.coalesce(lookup(first, CONNECTOR_CORPUS), lookup(leaf_agent, AGENT_CORPUS), by_department)
    )


def needs_minimisation(text: Column) -> Column:
    return text.contains("***-**-") | text.contains("******")


def missing_elements(persona: Column, fmt: Column, constraints: Column, gap: Column, pii: Column) -> Column:
    lacking = [~persona, ~fmt, ~constraints, gap, pii]
    return F.array_remove(
        F.array(*(F.when(test, name).otherwise("") for name, test in zip(V.MISSING_ELEMENTS, lacking))), ""
    )


def needs_improvement(level: Column, gap: Column, pii: Column) -> Column:
    return (level != V.LEVEL_3) | gap | pii


def recommendation(missing: Column) -> Column:
    """One sentence of joined advice and, where needed, one on identifiers."""
    steps = F.concat_ws(", ", *(F.when(F.array_contains(missing, k), v) for k, v in ADVICE.items()))
    text = F.concat_ws(
        " ",
        F.when(steps != "", F.concat(F.lit("To improve, "), steps, F.lit("."))),
        F.when(F.array_contains(missing, "pii_minimization"), F.lit(PII_ADVICE)),
    )
    return F.when(text == "", "No change needed.").otherwise(text)


def without_masked_values(text: Column, pii: Column) -> Column:
    """Replace the visible tails of masked numbers, where there are any, by neutral ids."""
    neutral = F.regexp_replace(
        F.regexp_replace(text, r"\*{3}-\*{2}-[0-9]{4}", "[EMPLOYEE_ID]"),
        r"\*{6}[0-9]{4}", "[RECORD_ID]",
    )
    return F.when(pii, neutral).otherwise(text)


def rewritten_prompt(safe_text: Column, department: Column, missing: Column, target: Column) -> Column:
    """The prompt with the missing parts added and its source named."""

    def lacks(name: str, sentence: Column) -> Column:
        return F.when(F.array_contains(missing, name), sentence)

    return F.concat_ws(
        " ",
        lacks("persona_role", F.concat(F.lit("Act as a "), department, F.lit(" specialist."))),
        safe_text,
        F.concat(F.lit("Use "), target, F.lit(" as the source.")),
        lacks("explicit_output_format", F.lit("Return the result as a Markdown table.")),
        lacks("scope_constraints", F.lit("Use at most 200 words and name the plant, shift or lot.")),
    )


def recommended_target(types: Column, leaf_agent: Column, connectors: Column, corpus: Column) -> Column:
    """Agent for the sensitive data found, else the agent or connector in use, else by corpus."""
    ids = {n: agent for n, agent, *_ in V.AGENTS}
    usable = [c for c in V.CONNECTORS if c != V.NOT_RECOMMENDED]
    first = F.get(connectors, 0)

    return (
        F.when(contains_any(types, V.MEDICAL), ids[10])
        .when(contains_any(types, V.ACCOUNT, V.ROUTING), ids[9])
        .when(contains_any(types, V.SSN, V.DOB), ids[8])
        .when(leaf_agent.isin(*ids.values()), leaf_agent)
        .when(first.isin(*usable), first)
        .otherwise(lookup(corpus, CORPUS_TARGET))
    )
