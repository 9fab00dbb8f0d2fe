"""Names and numbers that telemetry, dashboards and downstream
readers rely on verbatim. Everything here is data, not logic."""

# --- fixed values: interaction types and native-chat markers -----------------
CHAT = "GE_CHAT_CONNECTOR_SEARCH"
AGENT = "AGENT_TREE_EXECUTION"
NATIVE_CHAT_AGENT = "NONE (Native GE Chat)"
CHAT_PATH_PREFIX = "GE_Chat_Window -> "
CONNECTOR_SEPARATOR = " + "
PATH_SEPARATOR = " -> "

# --- fixed values: raw log streams -------------------------------------------
CHAT_STREAM = "gemini-enterprise-chat-connector-telemetry"
AGENT_STREAM = "gemini-enterprise-agent-telemetry"
CHAT_SERVICE = "discoveryengine.googleapis.com"
AGENT_SERVICE = "aiplatform.googleapis.com/ReasoningEngine"

# --- fixed values: sensitive information types -------------------------------
SSN = "US_SOCIAL_SECURITY_NUMBER"
SYNTHETIC_SSN = "CME_SYNTHETIC_US_SSN"
PERSON = "PERSON_NAME"
EMAIL = "EMAIL_ADDRESS"
DOB = "DATE_OF_BIRTH"
ACCOUNT = "FINANCIAL_ACCOUNT_NUMBER"
ROUTING = "US_BANK_ROUTING_MICR"
MEDICAL = "MEDICAL_TERM"
INFO_TYPES = [SSN, PERSON, EMAIL, DOB, ACCOUNT, ROUTING, MEDICAL]

# --- fixed values: likelihood scale, lowest first ----------------------------
LIKELIHOODS = ["VERY_UNLIKELY", "UNLIKELY", "POSSIBLE", "LIKELY", "VERY_LIKELY"]

# --- fixed values: risk levels, most severe first ----------------------------
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]

# --- fixed values: judge enumerations ----------------------------------------
INTENTS = [
    "generation_drafting",
    "transformation_summary",
    "code_scripting",
    "info_seeking_qa",
    "data_extraction",
    "analytical_reasoning",
]
COMPLEXITIES = ["low", "medium", "high"]
MANUAL_MINUTES = {"low": 5, "medium": 15, "high": 45}
LEVEL_1 = "level_1_underspecified"
LEVEL_2 = "level_2_basic_directive"
LEVEL_3 = "level_3_well_engineered"
LEVELS = [LEVEL_1, LEVEL_2, LEVEL_3]
MATURITY_MULTIPLIERS = {LEVEL_1: 0.5, LEVEL_2: 0.75, LEVEL_3: 1.0}
DEFAULT_MULTIPLIER = 0.75
GROUNDING_RAG = "enterprise_rag"
GROUNDING_PASTED = "in_context_attachment"
GROUNDING_NONE = "parametric_general"
GROUNDINGS = [GROUNDING_RAG, GROUNDING_PASTED, GROUNDING_NONE]
CORPORA = [
    "hr_policy",
    "product_docs",
    "sales_collateral",
    "it_support",
    "codebase",
    "unknown",
]
MISSING_ELEMENTS = [
    "persona_role",
    "explicit_output_format",
    "scope_constraints",
    "enterprise_rag_connector",
    "pii_minimization",
]

# --- fixed values: enterprise connectors (15 accepted as input) --------------
CONNECTORS = [
    "SharePoint_Manufacturing_SOPs",
    "ServiceNow_Plant_Tickets",
    "Jira_Quality_CAPA",
    "SAP_ERP_Materials",
    "SAP_ERP_Financials",
    "Google_Drive_Finance_Q3",
    "SAP_ERP_Procurement",
    "SharePoint_Vendor_Contracts",
    "Workday_HR_Records",
    "SharePoint_Union_Contracts",
    "Workday_Payroll_Docs",
    "Google_Drive_Garnishment_Orders",
    "Google_Drive_Shift_Logs",
    "ServiceNow_HR_Case_Mgmt",
    "Confluence_Safety_OSHA_Policies",
]
# the one connector that is accepted as input but never recommended
NOT_RECOMMENDED = "Google_Drive_Shift_Logs"

# --- fixed values: agent catalog (number, id, name, pillar, engine, parent) --
ROUTER = "CME_Enterprise_Router"
AGENTS = [
    (1, "1_Plant_Operations_Shift_Coordinator", "Plant Operations & Shift Coordinator",
     "Operations", "cme-ops-shift-coordinator-01", None),
    (2, "2_Predictive_Maintenance_PLC_Agent", "Predictive Maintenance & PLC Agent",
     "Operations", "cme-ops-plc-maintenance-02", 1),
    (3, "3_Supply_Chain_Expediting_Agent", "Supply Chain & Expediting Agent",
     "Operations", "cme-ops-supply-expediting-03", 1),
    (4, "4_ISO_Quality_CAPA_Agent", "ISO Quality & CAPA Agent",
     "Operations", "cme-ops-quality-capa-04", 1),
    (5, "5_Plant_Controllership_Cost_Agent", "Plant Controllership & Cost Agent",
     "Finance", "cme-fin-controllership-05", None),
    (6, "6_CapEx_Automation_ROI_Agent", "CapEx & Automation ROI Agent",
     "Finance", "cme-fin-capex-roi-06", 5),
    (7, "7_Direct_Procurement_Tariff_Agent", "Direct Procurement & Tariff Agent",
     "Finance", "cme-fin-procurement-tariff-07", 5),
    (8, "8_HR_Onboarding_I9_Verification_Agent", "HR Onboarding & I-9 Verification Agent",
     "HR", "cme-hr-onboarding-i9-08", None),
    (9, "9_Payroll_Tax_Garnishment_Agent", "Payroll, Tax & Wage Garnishment Agent",
     "HR", "cme-hr-payroll-garnishment-09", 8),
    (10, "10_Workers_Comp_FMLA_OSHA_Agent", "Workers' Comp, FMLA & OSHA Claims Agent",
     "HR", "cme-hr-workers-comp-osha-10", 8),
]

# --- fixed values: actor ids --------------------------------------------------
ACTOR_PREFIX = "usr_"
ANONYMOUS_ACTOR = "usr_anonymous"
ACTOR_HASH_DOMAIN = "cme-ge-dlp-actor-domain-v1:"

# --- fixed values: incident terms of the cross-department story ---------------
INCIDENT_TERMS = ["Line 3", "Lot #402"]

# --- fixed values: loader chunk -----------------------------------------------
CHUNK_ROWS = 250
