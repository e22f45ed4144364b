"""Names, word lists, labels and formats that results depend on.

Nothing here is logic. Every entry must keep its exact text, because cleaned
columns, routed questions and written answers are compared by value.
"""

# Text that means "no value" (compared in lower case).
MISSING_TOKENS = ("", "<na>", "na", "nan", "none", "null", "nat")

# Canonical column -> accepted source names, first present wins.
COLUMN_ALIASES = {
    "policy_record_id": ("index", "policy_record_id", "policy_id", "record_id"),
    "server_name": ("servername", "server_name"),
    "service_provider": ("serviceprovidername", "service_provider_name", "service_provider"),
    "payer_country": ("payercountry", "payer_country"),
    "payer_name": ("payer_name", "payername", "payer"),
    "payer_key": ("payer_key", "payerkey"),
    "master_contract": ("mastercontract", "master_contract"),
    "master_contract_key": ("mastercontractkey", "master_contract_key"),
    "policy_type": ("policy_type", "policytype_main"),
    "policy_type_detail": ("policytype", "policy_type_detail"),
    "licensing_authority": ("licensing_authority", "licensingauthority"),
    "network_type": ("op_member_network_type", "network_type"),
    "network_group": ("networkgroup", "network_group"),
    "dependency": ("dependency",),
    "nationality": ("nationality",),
    "marital_status": ("maritalstatus", "marital_status"),
    "gender": ("gender",),
    "dependent_status": ("isdependent", "is_dependent", "dependent_status"),
    "age_profile": ("age_profile", "ageprofile"),
    "age_bucket": ("age_bucket", "agebucket"),
    "payer_type": ("payer_type", "payertype"),
    "beneficiary_key": ("beneficiarykey", "beneficiary_key"),
    "beneficiary_payer_key": ("beneficiarypayerkey", "beneficiary_payer_key"),
    "registered_user_key": ("registered_user_key", "registereduserkey"),
    "app_name": ("appname", "app_name"),
    "gross_premium_usd": ("gross_premium_usd", "grosspremiumusd"),
    "net_premium_usd": ("net_premium_usd", "netpremiumusd"),
    "tpa_fee_usd": ("tpa_usd", "tpa_fee_usd", "tpafeeusd"),
    "uw_year": ("uwyear", "uw_year", "underwriting_year"),
    "member_start_date": ("member_start_date", "memberstartdate"),
    "member_stop_date": ("member_stop_date", "memberstopdate"),
    "registration_date": ("registrationdate", "registration_date"),
    "registration_year": ("registrationyear", "registration_year"),
    "reload_timestamp": ("reload_ts", "reloadtimestamp", "reload_timestamp"),
    "rn1": ("rn1",),
}

# Canonical columns by type; everything else is text.
NUMBER_COLUMNS = ("gross_premium_usd", "net_premium_usd", "tpa_fee_usd")
INTEGER_COLUMNS = ("uw_year", "registration_year", "rn1")
DATE_COLUMNS = ("member_start_date", "member_stop_date", "registration_date")
TIMESTAMP_COLUMNS = ("reload_timestamp",)

# Columns a source must have.
REQUIRED_COLUMNS = (
    "beneficiary_key",
    "gross_premium_usd",
    "net_premium_usd",
    "tpa_fee_usd",
    "uw_year",
    "member_start_date",
    "member_stop_date",
)

# Scope attribute -> (column, label). Label order is display order.
SCOPE_COLUMNS = {
    "payer_countries": "payer_country",
    "payers": "payer_name",
    "providers": "service_provider",
    "contracts": "master_contract",
    "policy_types": "policy_type",
    "policy_type_details": "policy_type_detail",
    "licensing_authorities": "licensing_authority",
    "network_types": "network_type",
    "network_groups": "network_group",
    "payer_types": "payer_type",
    "server_names": "server_name",
    "app_names": "app_name",
    "dependencies": "dependency",
    "nationalities": "nationality",
    "marital_statuses": "marital_status",
    "gender": "gender",
    "dependent_statuses": "dependent_status",
    "age_profiles": "age_profile",
    "age_buckets": "age_bucket",
}
SCOPE_LABELS = {
    "payer_countries": "payer country",
    "payers": "payer",
    "providers": "service provider",
    "server_names": "server name",
    "contracts": "master contract",
    "payer_types": "payer type",
    "policy_types": "policy type",
    "policy_type_details": "policy type detail",
    "licensing_authorities": "licensing authority",
    "network_types": "network type",
    "network_groups": "network group",
    "dependencies": "dependency",
    "nationalities": "nationality",
    "marital_statuses": "marital status",
    "gender": "gender",
    "dependent_statuses": "dependent status",
    "age_profiles": "age profile",
    "age_buckets": "age bucket",
    "app_names": "app name",
}

UNASSIGNED = "Unassigned"

# Delimiters a text extract may use, in order of preference.
DELIMITERS = (",", "\t", ";", "|")

# Metric -> words that ask for it, in catalogue order.
METRIC_PHRASES = {
    "gross_premium_usd": ("gross premium", "gross", "gp"),
    "net_premium_usd": ("net premium", "net", "np"),
    "tpa_fee_usd": ("tpa", "tpa fee", "fee", "fees"),
    "app_penetration_rate": ("app penetration", "mobile penetration", "penetration", "adoption"),
    "active_population": ("active population", "population", "active members"),
    "active_registered_users": ("active registered", "registered users", "registered user"),
    "unique_beneficiaries": ("beneficiary", "beneficiaries", "member", "members"),
    "net_to_gross_ratio": ("net to gross", "gross to net", "margin", "ratio"),
    "tpa_to_gross_ratio": ("tpa to gross", "tpa ratio"),
}

# Intent -> words that show it, in report order.
INTENT_PHRASES = {
    "economics": (
        "premium", "gross", "net", "tpa", "fee", "cost", "economics", "margin", "ratio",
    ),
    "adoption": (
        "app", "mobile", "penetration", "adoption", "registered", "registration", "digital",
    ),
    "population": ("population", "beneficiary", "member", "active"),
    "policy": ("policy", "product", "network", "underwriting"),
    "master_contract": ("master contract", "contract"),
    "demographic": ("demographic", "age bucket", "age band", "age group", "age profile"),
    "payer": ("payer", "insurer", "carrier"),
    "country": ("country", "countries", "market", "markets"),
    "trend": (
        "trend", "growth", "change", "increase", "decrease", "yoy", "mom", "month", "year",
        "over time", "compare", "versus", "vs",
    ),
}

# Entity class -> intent it implies, in the order intents are added.
ENTITY_INTENTS = {
    "payers": "payer",
    "payer_countries": "country",
    "policy_types": "policy",
    "master_contracts": "master_contract",
    "age_buckets": "demographic",
}

# Words that choose a time slice or a ranking.
TREND_WORDS = ("trend", "growth", "change", "month", "yoy", "mom", "over time")
LOWEST_WORDS = ("lowest", "least", "worst", "lagging", "weakest")
RANK_BY_ADOPTION_WORDS = ("app", "mobile", "penetration", "adoption", "registered")
RANK_BY_FEE_WORDS = ("tpa", "fee", "cost", "margin", "ratio")

# Months of a trend, and entities that evidence lists when none is named.
TRAILING_ROWS = 24
TOP_ENTITIES = 12

# Evidence table -> metric -> description.
METRIC_CATALOG = {
    "summary": {
        "policy_records": "Policy-year records in the applied scope.",
        "unique_beneficiaries": "Distinct beneficiaries in the applied scope.",
        "master_contracts": "Distinct master contracts in the applied scope.",
        "registered_users": "Distinct registered application users.",
        "registered_beneficiaries": "Beneficiaries linked to a registered user.",
        "gross_premium_usd": "Gross premium in USD.",
        "net_premium_usd": "Net premium in USD.",
        "tpa_fee_usd": "TPA fee in USD.",
        "latest_active_population": "Distinct active beneficiaries at the latest month-end.",
        "latest_active_month": "Latest active-population month-end.",
    },
    "monthly_kpis": {
        "active_population": "Distinct active beneficiaries at each month-end.",
        "active_registered_users": "Distinct active registered users at each month-end.",
        "gross_premium_usd": "Allocated gross premium in USD by active month.",
        "net_premium_usd": "Allocated net premium in USD by active month.",
        "tpa_fee_usd": "Allocated TPA fee in USD by active month.",
    },
    "monthly_country_kpis": {
        "active_population": "Distinct active beneficiaries by payer country and month-end.",
        "active_registered_users": (
            "Distinct active registered users by payer country and month-end."
        ),
    },
    "premium_by_year": {
        "beneficiaries": "Distinct beneficiaries by underwriting year.",
        "gross_premium_usd": "Gross premium in USD by underwriting year.",
        "net_premium_usd": "Net premium in USD by underwriting year.",
        "tpa_fee_usd": "TPA fee in USD by underwriting year.",
    },
    "payer_review": {
        "beneficiaries": "Distinct beneficiaries by payer.",
        "registered_users": "Distinct registered users by payer.",
        "gross_premium_usd": "Gross premium in USD by payer.",
        "net_premium_usd": "Net premium in USD by payer.",
        "tpa_fee_usd": "TPA fee in USD by payer.",
        "app_penetration_rate": "Registered users divided by beneficiaries by payer.",
        "net_to_gross_ratio": "Net premium divided by gross premium by payer.",
        "tpa_to_gross_ratio": "TPA fee divided by gross premium by payer.",
    },
    "master_contract_network_premium": {
        "gross_premium_usd": "Gross premium in USD by master contract and network type.",
    },
    "age_bucket_review": {
        "beneficiaries": "Distinct beneficiaries by age bucket.",
        "registered_users": "Distinct registered users by age bucket.",
        "gross_premium_usd": "Gross premium in USD by age bucket.",
        "net_premium_usd": "Net premium in USD by age bucket.",
        "tpa_fee_usd": "TPA fee in USD by age bucket.",
        "app_penetration_rate": "Registered users divided by beneficiaries by age bucket.",
        "net_to_gross_ratio": "Net premium divided by gross premium by age bucket.",
        "tpa_to_gross_ratio": "TPA fee divided by gross premium by age bucket.",
    },
    "policy_type_review": {
        "beneficiaries": "Distinct beneficiaries by policy type.",
        "gross_premium_usd": "Gross premium in USD by policy type.",
        "net_premium_usd": "Net premium in USD by policy type.",
        "tpa_fee_usd": "TPA fee in USD by policy type.",
    },
    "mobile_by_payer": {
        "unique_beneficiaries": "Distinct beneficiaries by payer.",
        "unique_registered_users": "Distinct registered users by payer.",
        "registered_user_penetration": "Registered users divided by beneficiaries by payer.",
        "linked_beneficiary_coverage": "Beneficiaries linked to a registered user by payer.",
    },
}

# Evidence table -> columns always shown.
IDENTITY_COLUMNS = {
    "summary": ("policy_records",),
    "monthly_kpis": ("month_end",),
    "monthly_country_kpis": ("month_end", "payer_country"),
    "premium_by_year": ("uw_year", "beneficiaries"),
    "payer_review": ("payer_name",),
    "master_contract_network_premium": ("master_contract", "network_type"),
    "age_bucket_review": ("age_bucket",),
    "policy_type_review": ("policy_type", "beneficiaries"),
    "mobile_by_payer": ("payer_name",),
}

# Requested metric -> columns shown in every table that has them.
METRIC_COLUMNS = {
    "gross_premium_usd": ("gross_premium_usd",),
    "net_premium_usd": ("net_premium_usd",),
    "tpa_fee_usd": ("tpa_fee_usd",),
    "net_to_gross_ratio": ("gross_premium_usd", "net_premium_usd", "net_to_gross_ratio"),
    "tpa_to_gross_ratio": ("gross_premium_usd", "tpa_fee_usd", "tpa_to_gross_ratio"),
    "active_population": (
        "latest_active_population", "latest_active_month", "active_population",
    ),
    "active_registered_users": ("active_registered_users", "registered_users"),
    "unique_beneficiaries": ("unique_beneficiaries", "beneficiaries"),
}
# The columns that penetration needs, by evidence table.
PENETRATION_COLUMNS = {
    "summary": ("unique_beneficiaries", "registered_users", "registered_beneficiaries"),
    "monthly_kpis": ("active_population", "active_registered_users"),
    "monthly_country_kpis": ("active_population", "active_registered_users"),
    "payer_review": ("beneficiaries", "registered_users", "app_penetration_rate"),
    "age_bucket_review": ("beneficiaries", "registered_users", "app_penetration_rate"),
    "mobile_by_payer": (
        "unique_beneficiaries", "unique_registered_users",
        "registered_user_penetration", "linked_beneficiary_coverage",
    ),
}

# Metric -> columns that may hold it, first non-null wins.
METRIC_CANDIDATES = {
    "gross_premium_usd": ("gross_premium_usd",),
    "net_premium_usd": ("net_premium_usd",),
    "tpa_fee_usd": ("tpa_fee_usd",),
    "active_population": ("active_population", "latest_active_population"),
    "active_registered_users": ("active_registered_users", "registered_users"),
    "unique_beneficiaries": ("unique_beneficiaries", "beneficiaries"),
    "app_penetration_rate": ("app_penetration_rate", "registered_user_penetration"),
    "net_to_gross_ratio": ("net_to_gross_ratio",),
    "tpa_to_gross_ratio": ("tpa_to_gross_ratio",),
}
# Rate -> (numerator candidates, denominator candidates).
RATE_PARTS = {
    "app_penetration_rate": (
        ("registered_users", "unique_registered_users", "active_registered_users"),
        ("beneficiaries", "unique_beneficiaries", "active_population", "latest_active_population"),
    ),
    "net_to_gross_ratio": (("net_premium_usd",), ("gross_premium_usd",)),
    "tpa_to_gross_ratio": (("tpa_fee_usd",), ("gross_premium_usd",)),
}

# Which requested metric leads an answer, in priority order.
METRIC_PRIORITY = (
    "app_penetration_rate",
    "tpa_to_gross_ratio",
    "net_to_gross_ratio",
    "active_population",
    "active_registered_users",
    "gross_premium_usd",
    "net_premium_usd",
    "tpa_fee_usd",
    "unique_beneficiaries",
)
METRIC_LABELS = {
    "gross_premium_usd": "gross premium",
    "net_premium_usd": "net premium",
    "tpa_fee_usd": "TPA fee",
    "app_penetration_rate": "app penetration",
    "active_population": "active population",
    "active_registered_users": "active registered users",
    "unique_beneficiaries": "unique beneficiaries",
    "net_to_gross_ratio": "net-to-gross ratio",
    "tpa_to_gross_ratio": "TPA-to-GP ratio",
}
RATE_METRICS = ("app_penetration_rate", "net_to_gross_ratio", "tpa_to_gross_ratio")
COUNT_METRICS = ("active_population", "active_registered_users", "unique_beneficiaries")

# Focus labels, highest precedence first.
FOCUS_LABELS = {
    "named_contract": "Named master-contract review",
    "contract": "Master-contract review",
    "named_age": "Named age-bucket demographic review",
    "age": "Age-bucket demographic review",
    "payer_adoption": "Payer digital-adoption comparison",
    "named_payer": "Named payer review",
    "named_country": "Named country review",
    "named_policy_type": "Named policy-type review",
    "adoption": "Digital-adoption review",
    "economics": "Premium and economics review",
    "population": "Active-population review",
    "policy": "Policy mix review",
    "portfolio": "Portfolio review",
}

# Evidence gaps, by entity class and table that should have held them.
MISSING_EVIDENCE = {
    ("payers", "payer_review"): (
        "No payer-level aggregate row was available for the payer named in the question."
    ),
    ("payer_countries", "monthly_country_kpis"): (
        "No country-level active-population row was available for the country named in the "
        "question."
    ),
    ("policy_types", "policy_type_review"): (
        "No policy-type aggregate row was available for the policy type named in the question."
    ),
    ("master_contracts", "master_contract_network_premium"): (
        "No master-contract network aggregate row was available for the contract named in the "
        "question."
    ),
    ("age_buckets", "age_bucket_review"): (
        "No age-bucket aggregate row was available for the demographic segment named in the "
        "question."
    ),
}
COUNTRY_ECONOMICS_LIMITATION = (
    "Country-level activity metrics are available; premium economics remain aggregated at payer "
    "and policy-type level."
)
SUMMARY_ONLY_LIMITATION = (
    "The selected scope only returned portfolio-level aggregate evidence for this question."
)

# Answer wording.
NO_ANSWER_TEXT = (
    "The selected scope does not contain enough aggregate evidence to answer this question "
    "reliably."
)
NO_EVIDENCE_TEXT = "No relevant aggregate evidence was returned for the selected scope."
DEFAULT_TARGET = "the lowest-performing segment"
ACTIONS = {
    "adoption": (
        "Set a 90-day registration activation plan for {target}, focused on enrolment and "
        "renewal touchpoints.",
        "Track active registered users and app penetration monthly, with a named owner for the "
        "conversion gap.",
    ),
    "economics": (
        "Review pricing, benefit design, and TPA terms for {target} before the next renewal "
        "decision.",
        "Use the premium and ratio trend as a monthly value-for-money control, not a one-off "
        "year-end review.",
    ),
    "population": (
        "Align service capacity and member communications to the latest active-population trend.",
        "Review the country and payer mix behind material movement before changing the operating "
        "plan.",
    ),
    "other": (
        "Prioritise the largest evidence-backed variance in the next portfolio review.",
        "Assign a payer or policy owner, action date, and monthly outcome metric before the next "
        "QBR.",
    ),
}

# Wording of the prompt dataset.
PROMPT_INTRO = (
    "You are a senior analytics strategist preparing a concise CXO‑grade answer. "
    "Use ONLY the aggregate metrics and tables provided. Do not infer missing values, "
    "do not reference raw data, and do not generate SQL.\n\n"
    "Your response MUST be under 190 words and MUST contain exactly three Markdown "
    "sections in this order:\n"
    "1. **Executive answer** — A direct, decision‑ready conclusion grounded only in "
    "the evidence.\n"
    "2. **Evidence used** — Cite the specific aggregate fields and values that support "
    "your answer.\n"
    "3. **Recommended actions** — 2–4 practical next steps.\n\n"
    "Guidelines:\n"
    "- Be factual, concise, and quantitative.\n"
    "- If evidence is insufficient, state the limitation explicitly.\n"
    "- Do not speculate or invent metrics.\n"
    "- Maintain an executive consulting tone.\n\n"
)
PROMPT_QUESTION_HEADING = "Executive question:\n"
PROMPT_EVIDENCE_HEADING = "\n\nAggregate evidence (JSON):\n"

# Lower-case letters whose case folding contains plain ASCII letters.
CASE_FOLDS = {
    "ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi",
    "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}

# Domains of the synthetic extract.
SYNTHETIC_FIRST_RECORD = 11310000
SYNTHETIC_YEARS = (2024, 2025, 2026)
SYNTHETIC_PAYERS = (
    # country, payer, payer key, server, provider, authority, network type, contracts
    ("Egypt", "Allianz", "EG-ALL", "EGP", "NEXtCARE Egypt", "MOH", "GN",
     ("CIB Families", "Nile Manufacturing")),
    ("United Arab Emirates", "Bupa", "AE-BUP", "UAE", "NEXtCARE UAE", "DHA", "GN Plus",
     ("Atlas Aviation", "Dubai Retail Group")),
    ("Saudi Arabia", "AXA", "SA-AXA", "KSA", "MedNet Saudi", "CCHI", "Regional",
     ("Riyadh Technology", "Jeddah Logistics")),
    ("Qatar", "MetLife", "QA-MET", "QAT", "QLM Health Services", "QCHP", "GN",
     ("Doha Energy", "Qatar Education Trust")),
    ("Oman", "GIG", "OM-GIG", "OMN", "NEXtCARE Oman", "MOH", "Regional",
     ("Muscat Hospitality", "Sohar Industrial")),
    ("Bahrain", "Cigna", "BH-CIG", "BHR", "Tawuniya Health", "NHRA", "GN Plus",
     ("Manama Finance", "Bahrain Commerce")),
)
SYNTHETIC_PROFILES = (
    # dependency, dependent status, gender, age profile, age bucket, nationality, marital status
    ("Principal", "Principal", "Female", "Adult", "30-39", "Egypt", "Married"),
    ("Principal", "Principal", "Male", "Adult", "40-49", "India", "Married"),
    ("Spouse", "Dependent", "Female", "Adult", "30-39", "Philippines", "Married"),
    ("Spouse", "Dependent", "Male", "Adult", "40-49", "Jordan", "Married"),
    ("Child", "Dependent", "Female", "Child", "0-17", "Egypt", "Single"),
    ("Child", "Dependent", "Male", "Child", "0-17", "Pakistan", "Single"),
    ("Principal", "Principal", "Female", "Adult", "50-59", "Lebanon", "Single"),
    ("Principal", "Principal", "Male", "Senior", "60+", "United Kingdom", "Married"),
    ("Parent", "Dependent", "Female", "Senior", "60+", "Sudan", "Widowed"),
    ("Parent", "Dependent", "Male", "Senior", "60+", "Syria", "Married"),
    ("Principal", "Principal", "Female", "Adult", "18-29", "United Arab Emirates", "Single"),
    ("Principal", "Principal", "Male", "Adult", "18-29", "Saudi Arabia", "Single"),
    ("Spouse", "Dependent", "Female", "Adult", "50-59", "Kenya", "Married"),
    ("Child", "Dependent", "Male", "Child", "0-17", "Nigeria", "Single"),
    ("Principal", "Principal", "Female", "Adult", "40-49", "France", "Married"),
    ("Principal", "Principal", "Male", "Adult", "30-39", "Germany", "Married"),
)
SYNTHETIC_PRODUCTS = (
    ("Group", "Corporate"), ("Group", "Family"), ("Individual", "Retail"), ("SME", "Corporate"),
)
SYNTHETIC_NETWORK_GROUPS = ("NonPCP", "PCP", "Premium")
SYNTHETIC_PAYER_TYPES = ("Insured", "Sponsor", "Self-funded")
SYNTHETIC_APPS = ("Lumi", "MyHealth", "CareHub")
