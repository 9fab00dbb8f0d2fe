"""DuckDB side of the check: the telemetry and every derived column as plain SQL.

Written separately from the Spark code: texts are assembled by concatenation, regexes
use RE2 word boundaries, and means are rounded in whole numbers.
"""

from __future__ import annotations

import hashlib

from checks import telemetry as T

TEST_SEED = "promptlens-public-test-key"

_KEY = hashlib.sha256(TEST_SEED.encode()).digest().ljust(64, b"\0")
INNER = bytes(b ^ 0x36 for b in _KEY).hex()
OUTER = bytes(b ^ 0x5C for b in _KEY).hex()


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _filled(template: str) -> str:
    """Replaces the placeholders by the columns of the same names."""
    for name in ("name", "email", "ssn", "dob", "acct", "routing", "injury", "site", "shift", "line", "code", "lot"):
        column = {"name": "nam", "email": "mail", "routing": "rout", "site": "plant"}.get(name, name)
        template = f"replace({template}, '{{{name}}}', {column})"
    return template


_SUBJECT = ",\n    ".join(
    f"{_list(x[i] for x in T.SUBJECTS)}[(id // 7) % {len(T.SUBJECTS)} + 1] AS {name}"
    for i, name in enumerate(("nam", "mail", "ssn", "dob", "acct", "rout"))
)
_TASK = f"(id // 4 + k) % {len(T.TASKS)} + 1"

EVENTS = f"""
ev AS (
  SELECT event_id AS id, ts, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         event_id % 3 = 0 AS chat,
         (event_id // 11) % 5 AS style
  FROM events),
scene AS (
  SELECT *,
    CASE user_id % 3 WHEN 0 THEN 'Operations' WHEN 1 THEN 'Finance' ELSE 'HR' END AS department,
    {_list(T.SITES)}[(user_id // 3) % 5 + 1] AS plant,
    'Shift ' || (user_id % 2 + 1 + (user_id // 2) % 2) AS shift,
    {_list(T.ROLES)}[(user_id // 5) % 4 + 1] AS role,
    (id // 3 + k) % 10 + 1 AS agent_num,
    'Line ' || ((id // 2) % 5 + 1) AS line,
    {_list(T.CODES)}[(id // 4) % 3 + 1] AS code,
    CASE WHEN (id // 6) % 2 = 0 THEN 'Lot #402' ELSE 'Lot #517' END AS lot,
    {_SUBJECT},
    {_list(T.INJURIES)}[(id // 5) % {len(T.INJURIES)} + 1] AS injury,
    {_list(T.CONNECTOR_SETS)}[(id // 9) % 16 + 1] AS conn
  FROM ev),
parts AS (
  SELECT *,
    {_list(t[0] for t in T.TASKS)}[{_TASK}] AS topic,
    {_filled(f"{_list(t[1] for t in T.TASKS)}[{_TASK}]")} AS entity,
    {_filled(f"{_list(t[2] for t in T.TASKS)}[{_TASK}]")} AS task,
    {_filled(f"{_list(T.CLAUSES)}[(id // 5) % {len(T.CLAUSES)} + 1]")} AS clause
  FROM scene),
tele AS (
  SELECT * EXCLUDE (conn),
    CASE WHEN chat AND style NOT IN ({T.SEARCH}, {T.PASTED}) AND conn <> '' THEN string_split(conn, ',') ELSE CAST([] AS VARCHAR[]) END AS connectors,
    CASE style
      WHEN {T.CRISP} THEN '{T.OPENING}' || rtrim(task || ' ' || clause) || '{T.FORMAT_LINE}'
      WHEN {T.SEARCH} THEN {_list(T.SEARCH_TEXTS)}[user_id % 3 + 1]
      WHEN {T.LIMITED} THEN rtrim(task || ' ' || clause) || '{T.LIMIT_LINE}'
      WHEN {T.PASTED} THEN '{T.PASTED_TEXT}'
      ELSE rtrim(task || ' ' || clause) END AS prompt_text
  FROM parts),
raw AS (
  SELECT *,
    'log-' || id AS insert_id,
    date_trunc('milliseconds', ts) AS event_timestamp,
    CASE WHEN chat THEN 'GE_CHAT_CONNECTOR_SEARCH' ELSE 'AGENT_TREE_EXECUTION' END AS interaction_type,
    CASE WHEN chat THEN 'gemini-enterprise-chat-connector-telemetry' ELSE 'gemini-enterprise-agent-telemetry' END AS log_name,
    CASE WHEN id % 3 = 0 THEN 'NOTICE' END AS severity,
    md5('trace-' || id) AS trace_id,
    left(md5('span-' || id), 16) AS span_id,
    'user' || user_id || '@bottler.example' AS employee_email,
    'EMP-' || user_id AS employee_id,
    CASE WHEN chat THEN department
         ELSE CASE WHEN agent_num <= 4 THEN 'Operations' WHEN agent_num <= 7 THEN 'Finance' ELSE 'HR' END END AS pillar,
    ['1_Plant_Operations_Shift_Coordinator', '2_Predictive_Maintenance_PLC_Agent', '3_Supply_Chain_Expediting_Agent',
     '4_ISO_Quality_CAPA_Agent', '5_Plant_Controllership_Cost_Agent', '6_CapEx_Automation_ROI_Agent',
     '7_Direct_Procurement_Tariff_Agent', '8_HR_Onboarding_I9_Verification_Agent', '9_Payroll_Tax_Garnishment_Agent',
     '10_Workers_Comp_FMLA_OSHA_Agent'][agent_num] AS agent,
    CASE WHEN agent_num <= 4 THEN '1_Plant_Operations_Shift_Coordinator'
         WHEN agent_num <= 7 THEN '5_Plant_Controllership_Cost_Agent'
         ELSE '8_HR_Onboarding_I9_Verification_Agent' END AS lead_agent,
    90 + id * 37 % 4001 AS latency_ms,
    len(string_split(prompt_text, ' ')) + len(string_split(prompt_text, ' ')) % 3 + id % 17 AS prompt_tokens,
    40 + id * 13 % 701 AS response_tokens
  FROM tele),
flat AS (
  SELECT *,
    CASE WHEN chat THEN 'NONE (Native GE Chat)' ELSE lead_agent END AS root_agent,
    CASE WHEN chat THEN 'NONE (Native GE Chat)' ELSE agent END AS leaf_agent,
    CASE WHEN chat THEN 'GE_Chat_Window -> ' || coalesce(array_to_string(connectors, ' + '), '')
         WHEN agent = lead_agent THEN 'CME_Enterprise_Router -> ' || agent
         ELSE 'CME_Enterprise_Router -> ' || lead_agent || ' -> ' || agent END AS agent_tree_path
  FROM raw)"""

MASKED = f"""
found AS (
  SELECT *,
    regexp_matches(prompt_text, '\\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\b') AS f_dob,
    regexp_matches(prompt_text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') AS f_mail,
    regexp_matches(prompt_text, 'Acct #[0-9]{{10}}\\b') AS f_acct,
    regexp_matches(lower(prompt_text), '\\b(arthritis|asthma|bursitis|concussion|crush injury|dermatitis|diabetes|epilepsy|herniation|hypertension|migraine|sciatica|sprain|tinnitus)\\b') AS f_med,
    regexp_matches(prompt_text, '\\b({'|'.join(T.SUBJECT_NAMES)})\\b') AS f_name,
    regexp_matches(prompt_text, 'Routing #[0-9]{{9}}\\b') AS f_rout,
    regexp_matches(prompt_text, '\\b000-[0-9]{{2}}-[0-9]{{4}}\\b') AS f_ssn
  FROM flat),
masked AS (
  SELECT *,
    list_filter([
      CASE WHEN f_dob THEN 'DATE_OF_BIRTH' END, CASE WHEN f_mail THEN 'EMAIL_ADDRESS' END,
      CASE WHEN f_acct THEN 'FINANCIAL_ACCOUNT_NUMBER' END, CASE WHEN f_med THEN 'MEDICAL_TERM' END,
      CASE WHEN f_name THEN 'PERSON_NAME' END, CASE WHEN f_rout THEN 'US_BANK_ROUTING_MICR' END,
      CASE WHEN f_ssn THEN 'US_SOCIAL_SECURITY_NUMBER' END], lambda x: x IS NOT NULL) AS info_types,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(prompt_text,
      '\\b000-[0-9]{{2}}-([0-9]{{4}})\\b', '***-**-\\1', 'g'),
      'Acct #[0-9]{{6}}([0-9]{{4}})\\b', 'Acct #******\\1', 'g'),
      'Routing #[0-9]{{9}}\\b', 'Routing #[US_BANK_ROUTING_MICR]', 'g'),
      '\\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\b', '[DATE_OF_BIRTH]', 'g'),
      '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b', '[EMAIL_ADDRESS]', 'g'),
      '({'|'.join(T.SUBJECT_NAMES)})', '[PERSON_NAME]', 'g') AS prompt_text_masked,
    sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(employee_email)))) AS hmac_hex,
    f_ssn AND (f_med OR f_acct OR f_rout) AS is_toxic_combination,
    CASE WHEN NOT (f_dob OR f_mail OR f_acct OR f_med OR f_name OR f_rout OR f_ssn) THEN 'NONE'
         WHEN f_ssn AND (f_med OR f_acct OR f_rout) THEN 'CRITICAL'
         WHEN f_ssn OR f_med OR f_acct OR f_rout THEN 'HIGH'
         WHEN f_dob THEN 'MEDIUM' ELSE 'LOW' END AS dlp_risk_level,
    department = 'Operations' AND f_ssn AS is_shadow_prompt
  FROM found)"""

JUDGED = """
cues AS (
  SELECT *, 'usr_' || left(hmac_hex, 8) AS anonymous_actor_hash,
    lower(prompt_text_masked) AS t,
    len(string_split(prompt_text_masked, ' ')) AS words
  FROM masked),
verbs AS (
  SELECT *,
    regexp_extract(t, '(?:^|[^a-z])(draft|write|generate|create|prepare|compose|summarize|translate|rewrite|reformat|rephrase|code|debug|program|script|refactor|extract|parse|pull|tabulate|analyze|calculate|compute|compare|model|evaluate|correlate|reconcile|forecast)(?:[^a-z]|$)', 1) AS verb,
    regexp_matches(t, '\\b(act as|you are an?|as a senior|in the role of)\\b') AS has_persona,
    regexp_matches(t, '\\b(markdown|table|json|bullets?|bullet points?|checklist|numbered list|yaml)\\b') AS has_explicit_format,
    regexp_matches(t, '\\b(limit|at most|at least|no more than|within|exclude|must not|do not|fewer than)\\b') AS has_constraints,
    words BETWEEN 3 AND 5 AS is_search_query_style,
    regexp_matches(t, '\\b(root cause|correlate|tariff|variance|payback|fault|compliance|forecast)\\b') AS deep,
    CASE WHEN len(connectors) > 0 OR NOT chat OR regexp_matches(t, '\\b(sharepoint|servicenow|jira|sap|workday|confluence|google drive)\\b') THEN 'enterprise_rag'
         WHEN regexp_matches(t, '\\b(pasted|attached|following (data|log|rows)|here is the (data|log))\\b') THEN 'in_context_attachment'
         ELSE 'parametric_general' END AS grounding_type,
    len(connectors) > 0 OR regexp_matches(t, '(^|[^a-z])(line [0-9]|lot|plant|shift|tickets?|sop|polic(y|ies)|payroll|onboarding|vendor|supplier|press|capa|scrap|overtime|operators?|claim)([^a-z]|$)') AS requires_enterprise_knowledge,
    contains(prompt_text_masked, '***-**-') OR contains(prompt_text_masked, '******') AS pii
  FROM cues),
intents AS (
  SELECT *,
    CASE WHEN verb IN ('draft', 'write', 'generate', 'create', 'prepare', 'compose') THEN 'generation_drafting'
         WHEN verb IN ('summarize', 'translate', 'rewrite', 'reformat', 'rephrase') THEN 'transformation_summary'
         WHEN verb IN ('code', 'debug', 'program', 'script', 'refactor') THEN 'code_scripting'
         WHEN verb IN ('extract', 'parse', 'pull', 'tabulate') THEN 'data_extraction'
         WHEN verb <> '' THEN 'analytical_reasoning' ELSE 'info_seeking_qa' END AS functional_intent,
    CASE WHEN words <= 5 THEN 'level_1_underspecified'
         WHEN has_persona::INT + has_explicit_format::INT + has_constraints::INT >= 2 THEN 'level_3_well_engineered'
         ELSE 'level_2_basic_directive' END AS level,
    requires_enterprise_knowledge AND grounding_type = 'parametric_general' AS is_retrieval_gap
  FROM verbs),
facets AS (
  SELECT *,
    CASE WHEN functional_intent = 'code_scripting' OR (functional_intent = 'analytical_reasoning' AND deep) THEN 'high'
         WHEN is_search_query_style OR (functional_intent IN ('info_seeking_qa', 'transformation_summary') AND len(connectors) < 2) THEN 'low'
         ELSE 'medium' END AS task_complexity,
    CASE WHEN functional_intent = 'code_scripting' THEN 'codebase'
         WHEN len(connectors) > 0 THEN CASE
           WHEN connectors[1] = 'ServiceNow_Plant_Tickets' THEN 'it_support'
           WHEN connectors[1] IN ('SharePoint_Manufacturing_SOPs', 'Jira_Quality_CAPA', 'SAP_ERP_Materials', 'Google_Drive_Shift_Logs') THEN 'product_docs'
           WHEN connectors[1] IN ('SAP_ERP_Financials', 'Google_Drive_Finance_Q3', 'SAP_ERP_Procurement', 'SharePoint_Vendor_Contracts') THEN 'sales_collateral'
           ELSE 'hr_policy' END
         WHEN NOT chat THEN CASE WHEN agent_num IN (3, 5, 6, 7) THEN 'sales_collateral' WHEN agent_num >= 8 THEN 'hr_policy' ELSE 'product_docs' END
         ELSE CASE department WHEN 'HR' THEN 'hr_policy' WHEN 'Finance' THEN 'sales_collateral' ELSE 'product_docs' END END AS target_corpus,
    list_filter([
      CASE WHEN NOT has_persona THEN 'persona_role' END,
      CASE WHEN NOT has_explicit_format THEN 'explicit_output_format' END,
      CASE WHEN NOT has_constraints THEN 'scope_constraints' END,
      CASE WHEN is_retrieval_gap THEN 'enterprise_rag_connector' END,
      CASE WHEN pii THEN 'pii_minimization' END], lambda x: x IS NOT NULL) AS missing_elements,
    level <> 'level_3_well_engineered' OR is_retrieval_gap OR pii AS needs_improvement
  FROM intents),
target AS (
  SELECT *,
    CASE WHEN f_med THEN '10_Workers_Comp_FMLA_OSHA_Agent'
         WHEN f_acct OR f_rout THEN '9_Payroll_Tax_Garnishment_Agent'
         WHEN f_ssn OR f_dob THEN '8_HR_Onboarding_I9_Verification_Agent'
         WHEN NOT chat THEN agent
         WHEN len(connectors) > 0 AND connectors[1] <> 'Google_Drive_Shift_Logs' THEN connectors[1]
         ELSE CASE target_corpus WHEN 'hr_policy' THEN 'Workday_HR_Records'
                WHEN 'sales_collateral' THEN 'SAP_ERP_Financials' WHEN 'it_support' THEN 'ServiceNow_Plant_Tickets'
                WHEN 'codebase' THEN '2_Predictive_Maintenance_PLC_Agent' ELSE 'SharePoint_Manufacturing_SOPs' END
    END AS recommended_target,
    CASE task_complexity WHEN 'low' THEN 5 WHEN 'medium' THEN 15 ELSE 45 END AS minutes,
    CASE level WHEN 'level_1_underspecified' THEN 2 WHEN 'level_2_basic_directive' THEN 3 ELSE 4 END AS quarters,
    array_to_string(list_filter([
      CASE WHEN NOT has_persona THEN 'state the role the assistant should take' END,
      CASE WHEN NOT has_explicit_format THEN 'name the output format' END,
      CASE WHEN NOT has_constraints THEN 'limit length, time or scope' END,
      CASE WHEN is_retrieval_gap THEN 'query a connector that holds the internal records' END], lambda x: x IS NOT NULL), ', ') AS steps
  FROM facets),
curated AS (
  SELECT *,
    quarters / 4.0::DOUBLE AS maturity_multiplier,
    minutes * quarters / 4.0::DOUBLE AS adjusted_minutes_saved,
    minutes * (4 - quarters) / 4.0::DOUBLE AS potential_extra_minutes_unlocked,
    minutes * quarters AS adj_q,
    minutes * (4 - quarters) AS extra_q,
    CASE WHEN coalesce(steps, '') = '' AND NOT pii THEN 'No change needed.'
         ELSE concat_ws(' ', CASE WHEN steps <> '' THEN 'To improve, ' || steps || '.' END,
                        CASE WHEN pii THEN 'Refer to employee or claim ids instead of personal identifiers.' END) END AS recommendation,
    concat_ws(' ',
      CASE WHEN NOT has_persona THEN 'Act as a ' || department || ' specialist.' END,
      regexp_replace(regexp_replace(prompt_text_masked, '\\*\\*\\*-\\*\\*-[0-9]{4}', '[EMPLOYEE_ID]', 'g'), '\\*{6}[0-9]{4}', '[RECORD_ID]', 'g'),
      'Use ' || recommended_target || ' as the source.',
      CASE WHEN NOT has_explicit_format THEN 'Return the result as a Markdown table.' END,
      CASE WHEN NOT has_constraints THEN 'Use at most 200 words and name the plant, shift or lot.' END) AS rewritten
  FROM target)"""

# Messages with the disturbances: duplicates keep the original values, one second later.
DISTURBED = """
msg AS (
  SELECT *, 'msg-' || id AS event_id, id % 499 = 0 AS empty, id % 997 = 0 OR id % 241 = 0 AS broken, id % 350 = 0 AS junk, FALSE AS again FROM flat
  UNION ALL
  SELECT *, 'again-' || id AS event_id, FALSE AS empty, FALSE AS broken, FALSE AS junk, TRUE AS again FROM flat WHERE id % 50 = 0),
delivered AS (
  SELECT * EXCLUDE (department, interaction_type),
    CASE WHEN NOT again AND id % 211 = 0 THEN 'Unknown' ELSE department END AS department,
    CASE WHEN NOT chat THEN 'AGENT_TREE_EXECUTION' ELSE interaction_type END AS interaction_type
  FROM msg WHERE NOT empty AND NOT broken),
accepted AS (SELECT * FROM delivered WHERE NOT junk QUALIFY row_number() OVER (PARTITION BY insert_id ORDER BY again) = 1)"""


def sql(body: str, *, upto: str = "curated") -> str:
    """``body`` after the CTEs it needs: events, flat, masked, curated or delivered."""
    parts = {
        "flat": [EVENTS],
        "delivered": [EVENTS, DISTURBED],
        "masked": [EVENTS, MASKED],
        "curated": [EVENTS, MASKED, JUDGED],
    }[upto]
    return "WITH " + ",".join(parts) + "\n" + body
