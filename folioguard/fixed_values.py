"""Identifiers, texts, lists and limits that results must carry unchanged.

Nothing in this module computes anything; the operators read it.
"""

# --- fixed values: capabilities and quality dimensions, in reporting order ---
CAPABILITIES = (
    "quality_review",
    "transaction_analytics",
    "customer_analytics",
    "repayment_analytics",
    "risk_rule_evaluation",
    "model_exploration",
)
DIMENSION_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.20,
    "uniqueness": 0.15,
    "consistency": 0.15,
    "timeliness": 0.10,
    "fitness": 0.15,
}
QUALITY_DEFINITION = "dataset-quality/1.0.0"
VALIDATION_POLICY = "dataset-validation/1.0.0"

# --- fixed values: governed columns ---
GOVERNED_NUMERIC = (
    "transaction_amount",
    "income",
    "loan_amount",
    "existing_debt",
    "transaction_frequency",
    "account_age_months",
    "repayment_history_score",
    "defaulted",
    "risk_score",
)
MODEL_INPUTS = (
    "income",
    "loan_amount",
    "repayment_history_score",
    "existing_debt",
    "transaction_frequency",
    "account_age_months",
    "employment_status",
    "segment",
    "business_type",
    "region",
)
MODEL_NUMERIC = MODEL_INPUTS[:6]
MODEL_CATEGORICAL = MODEL_INPUTS[6:]
RULE_INPUTS = (
    "transaction_amount",
    "income",
    "loan_amount",
    "existing_debt",
    "repayment_history_score",
    "transaction_frequency",
)
REVIEW_COLUMNS = (
    "transaction_id",
    "customer_id",
    "date",
    "transaction_amount",
    "loan_amount",
    "income",
    "suspicious_category",
    "risk_level",
    "anomaly_score",
    "rules_evaluated_count",
    "rules_not_evaluated_count",
    "not_evaluated_rule_ids",
    "anomaly_notes",
)

# --- fixed values: rule ids and labels; the order decides a record's first category ---
RULESET_VERSION = "prototype-risk-rules/2.0.0"
RULES = (
    ("unusually_high_amount", "Unusually high amount"),
    ("duplicate_record", "Potential duplicate record"),
    ("spending_spike", "Sudden spending spike"),
    ("repayment_pattern", "High-risk repayment pattern"),
    ("loan_to_income", "Loan-to-income mismatch"),
    ("rapid_transactions", "Multiple transactions in short time"),
    ("debt_to_income", "High existing debt"),
)

# --- fixed values: dataset issue texts, keyed by issue code ---
# code: (severity, dimension, column, message, recovery, capabilities, override_allowed)
ISSUES = {
    "empty_dataset": (
        "block", "fitness", None,
        "The dataset contains no data rows.",
        "Upload a CSV with a header row and at least one data row.",
        CAPABILITIES, False),
    "missing_values": (
        "warn", "completeness", None,
        "The dataset contains missing values that may reduce downstream coverage.",
        "Review missingness by column and either correct, exclude, or document each treatment.",
        CAPABILITIES, False),
    "duplicate_rows": (
        "warn", "uniqueness", None,
        "The dataset contains exact duplicate rows.",
        "Confirm the authoritative business key and remove unintended duplicates.",
        CAPABILITIES, True),
    "missing_transaction_amount": (
        "block", "fitness", "transaction_amount",
        "Transaction analytics requires a mapped transaction amount column.",
        "Map a numeric amount column to transaction_amount and validate its unit and currency.",
        ("transaction_analytics",), False),
    "unparseable_transaction_amount": (
        "block", "validity", "transaction_amount",
        "Transaction amount contains no parseable numeric values.",
        "Remove non-numeric symbols or map a numeric amount column, then validate again.",
        ("transaction_analytics",), False),
    "invalid_transaction_amount": (
        "warn", "validity", "transaction_amount",
        "Some transaction amounts cannot be parsed as numbers and are excluded from aggregates.",
        "Correct or remove the invalid amount values, then validate again.",
        ("transaction_analytics",), False),
    "missing_event_date": (
        "block", "fitness", "date",
        "Time-based transaction analytics requires a mapped event date.",
        "Map the transaction event date and confirm its timezone and period semantics.",
        ("transaction_analytics",), False),
    "unparseable_event_date": (
        "block", "validity", "date",
        "The event date contains no parseable date values.",
        "Convert event dates to an unambiguous date format, then validate again.",
        ("transaction_analytics",), False),
    "invalid_event_date": (
        "warn", "validity", "date",
        "Some event dates cannot be parsed and are excluded from time-based analysis.",
        "Correct or remove invalid event dates, then validate again.",
        ("transaction_analytics",), False),
    "missing_customer_id": (
        "block", "fitness", "customer_id",
        "Customer analytics requires a mapped customer business identifier.",
        "Map a stable customer identifier and confirm its uniqueness semantics.",
        ("customer_analytics",), False),
    "empty_customer_id": (
        "block", "completeness", "customer_id",
        "The customer identifier contains no usable values.",
        "Populate stable customer identifiers, then validate again.",
        ("customer_analytics",), False),
    "missing_customer_ids": (
        "warn", "completeness", "customer_id",
        "Some records have no usable customer identifier and are excluded from customer metrics.",
        "Populate missing customer identifiers or document why those rows are excluded.",
        ("customer_analytics",), False),
    "missing_repayment_outcome": (
        "block", "fitness", None,
        "Repayment analytics requires an explicit repayment outcome field.",
        "Map defaulted or repayment_status to an authoritative outcome definition.",
        ("repayment_analytics",), False),
    "missing_model_inputs": (
        "block", "fitness", None,
        "Model exploration is missing required inputs: {columns}.",
        "Map every required model feature and validate its meaning before training.",
        ("model_exploration",), False),
    "missing_model_target": (
        "block", "fitness", None,
        "Model exploration requires an explicit, authoritative outcome target.",
        "Map an approved defaulted or repayment_status outcome; "
        "derived demonstration targets are not eligible.",
        ("model_exploration",), False),
    "missing_risk_rule_inputs": (
        "block", "fitness", None,
        "Risk-rule evaluation is missing required inputs: {columns}.",
        "Map every required rule input before evaluating suspicious activity.",
        ("risk_rule_evaluation",), False),
}
# --- fixed values: mapping-level issue texts ---
# code -> (severity, dimension, message, recovery, override_allowed)
MAPPING_ISSUES = {
    "missing_required_field": (
        "block", "completeness",
        "Required mapped field {concept} contains missing values.",
        "Populate the required source values or confirm a mapping with correct nullability.", False),
    "unparseable_required_field": (
        "block", "validity",
        "Mapped field {concept} contains values incompatible with its target type.",
        "Correct the source format or confirm the field against the correct governed type.", False),
    "unparseable_optional_field": (
        "warn", "validity",
        "Mapped field {concept} contains values incompatible with its target type.",
        "Correct the source format or confirm the field against the correct governed type.", True),
}

# --- fixed values: governed concepts, header aliases, concept -> dependent capabilities ---
CONCEPTS = (
    "customer_id",
    "transaction_id",
    "date",
    "transaction_amount",
    "currency",
    "income",
    "loan_amount",
    "existing_debt",
    "repayment_history_score",
    "defaulted",
    "repayment_status",
)
HEADER_ALIASES = {
    "client_id": "customer_id",
    "borrower_id": "customer_id",
    "txn_id": "transaction_id",
    "transaction_date": "date",
    "txn_date": "date",
    "txn_value": "transaction_amount",
    "transaction_value": "transaction_amount",
    "ccy": "currency",
    "monthly_income": "income",
    "principal": "loan_amount",
    "debt_balance": "existing_debt",
    "repayment_score": "repayment_history_score",
    "is_default": "defaulted",
    "loan_status": "repayment_status",
}
CONCEPT_CAPABILITIES = {
    "customer_id": ("customer_analytics",),
    "transaction_id": ("transaction_analytics",),
    "date": ("transaction_analytics",),
    "transaction_amount": ("transaction_analytics", "risk_rule_evaluation"),
    "currency": ("transaction_analytics",),
    "income": ("risk_rule_evaluation", "model_exploration"),
    "loan_amount": ("risk_rule_evaluation", "model_exploration"),
    "existing_debt": ("risk_rule_evaluation", "model_exploration"),
    "repayment_history_score": ("risk_rule_evaluation", "model_exploration"),
    "defaulted": ("repayment_analytics", "model_exploration"),
    "repayment_status": ("repayment_analytics", "model_exploration"),
}
TARGET_TYPES = ("string", "decimal", "integer", "boolean", "date", "datetime")

# --- fixed values: governed metrics, in reporting order ---
# metric_id: (label, unit, definition_version, source_fields)
METRICS = {
    "records_processed": ("Records processed", "records", "portfolio.records-processed/1.0.0", ("*",)),
    "data_quality_score": ("Composite data quality", "percent", QUALITY_DEFINITION, ("*",)),
    "missing_values": ("Missing values", "cells", "portfolio.missing-values/1.0.0", ("*",)),
    "duplicate_rows": ("Duplicate rows", "rows", "portfolio.duplicate-rows/1.0.0", ("*",)),
    "transaction_value": (
        "Total transaction value", "currency", "portfolio.transaction-value/1.0.0",
        ("transaction_amount", "date")),
    "average_transaction_value": (
        "Average transaction value", "currency", "portfolio.average-transaction-value/1.0.0",
        ("transaction_amount", "date")),
    "unique_customers": ("Unique customers", "customers", "portfolio.unique-customers/1.0.0", ("customer_id",)),
    "non_default_outcome_share": (
        "Non-default outcome share", "percent", "portfolio.non-default-outcome-share/1.0.0", ("defaulted",)),
    "suspicious_records": (
        "Suspicious records (rules)", "records", "portfolio.suspicious-rule-records/1.0.0", ("is_suspicious",)),
    "high_risk_records": (
        "High-priority rule records", "records", "portfolio.high-priority-rule-records/1.0.0",
        ("is_suspicious", "risk_level")),
}
# --- fixed values: reasons a metric is unavailable ---
# key -> (reason, recovery)
UNAVAILABLE = {
    "no_amount": (
        "The dataset has no mapped transaction amount.",
        "Map a numeric amount column to transaction_amount and confirm its currency."),
    "no_currency": (
        "Transaction currency is missing or ambiguous.",
        "Confirm one dataset currency or separate values by their mapped currency."),
    "no_outcome": (
        "A canonical defaulted outcome is not mapped.",
        "Map an authoritative binary defaulted outcome; do not infer scheduled repayment from row status."),
    "no_valid_outcome": (
        "The defaulted outcome contains no valid binary values.",
        "Correct defaulted values to the approved 0/1 outcome definition."),
    "no_rule_run": (
        "No versioned risk-rule evaluation is attached to this metric snapshot.",
        "Run the approved rule set and provide its version before displaying rule-derived counts."),
    "rule_output_incomplete": (
        "The risk-rule result is missing required output fields.",
        "Re-run the versioned rule evaluation and preserve is_suspicious and risk_level outputs."),
}

# --- fixed values: restricted column names and value patterns ---
RESTRICTED_COLUMNS = {
    "account_number": "financial_account",
    "bank_account": "financial_account",
    "bank_account_number": "financial_account",
    "bvn": "government_identifier",
    "card_number": "financial_account",
    "date_of_birth": "direct_identifier",
    "dob": "direct_identifier",
    "drivers_license": "government_identifier",
    "email": "contact",
    "email_address": "contact",
    "first_name": "direct_identifier",
    "full_name": "direct_identifier",
    "home_address": "contact",
    "last_name": "direct_identifier",
    "mobile": "contact",
    "mobile_number": "contact",
    "national_id": "government_identifier",
    "nin": "government_identifier",
    "pan": "financial_account",
    "passport_number": "government_identifier",
    "phone": "contact",
    "phone_number": "contact",
    "postal_address": "contact",
    "street_address": "contact",
    "surname": "direct_identifier",
}
VALUE_PATTERNS = (
    ("email_pattern", "contact",
     r"(?i)\b[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"),
    ("international_phone_pattern", "contact", r"(?<!\w)\+\d[\d\s().-]{7,}\d(?!\w)"),
    ("nigerian_phone_pattern", "contact", r"(?<!\d)0(?:70|71|80|81|90|91)\d{8}(?!\d)"),
    ("iban_pattern", "financial_account", r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
)
REDACTED = "[REDACTED]"

# --- fixed values: outcome labels ---
REPAYMENT_STATUS_OUTCOMES = {
    "repaid": 0,
    "paid": 0,
    "current": 0,
    "non-default": 0,
    "non default": 0,
    "defaulted": 1,
    "default": 1,
    "charged off": 1,
    "written off": 1,
}
TARGET_DEFINITIONS = {
    "defaulted": "defaulted.binary/1.0.0",
    "repayment_status": "repayment_status.binary/1.0.0",
}

# --- fixed values: model eligibility texts, code -> (severity, message, recovery) ---
MODEL_ISSUES = {
    "missing_features": (
        "block", "Required model features are missing: {columns}.",
        "Map every required feature and confirm its meaning before training."),
    "missing_target": (
        "block", "No explicit allowlisted binary outcome is available.",
        "Map an authoritative defaulted or repayment_status outcome; derived targets are prohibited."),
    "unmapped_target_values": (
        "warn", "Some outcome values are missing or outside the approved target mapping.",
        "Correct or explicitly map those outcomes; excluded rows are not used for training."),
    "single_target_class": (
        "block", "The eligible target contains only one outcome class.",
        "Provide authoritative examples from both outcome classes; a synthetic target will not be created."),
    "insufficient_rows": (
        "block", "Only {rows} eligible rows are available; this prototype requires {required}.",
        "Provide a larger representative dataset and independently justify the production sample threshold."),
    "insufficient_class_rows": (
        "block", "The minority class has fewer than {required} eligible rows.",
        "Collect more authoritative minority outcomes before model exploration."),
    "excessive_feature_missingness": (
        "block", "{column} has {rate} missing or invalid eligible values.",
        "Correct the feature or exclude it through a reviewed feature-definition change."),
    "excessive_category_cardinality": (
        "block", "{column} has {count} categories, above the prototype safety limit.",
        "Review semantic mapping and use a governed category treatment before training."),
}
MODEL_CODE_VERSION = "model-exploration/2.0.0"
FEATURE_DEFINITION = "credit-demo-features/1.0.0"
GROUP_SPLIT = "group_holdout/customer_id/1.0.0"
STRATIFIED_SPLIT = "stratified_random_holdout/1.0.0"
SCORE_SEMANTICS = "Uncalibrated demonstration model output; not a probability of default."
SCORE_ROUTING = "Manual review required"
SCORE_EXPLANATION = "No validated model-faithful local explanation is implemented."

# --- fixed values: admission policies, scope -> (limit, window seconds) ---
ADMISSION_POLICIES = {
    "login_ip": (10, 60),
    "login_account_failure": (5, 900),
    "oidc_callback_ip": (20, 300),
    "upload_reservation_actor": (10, 600),
    "assistant_query_actor": (30, 60),
    "report_generate_actor": (6, 600),
    "export_actor": (20, 600),
}

# --- fixed values: question intents, in precedence order, with their keywords ---
QUESTION_INTENTS = (
    ("biggest_risk", ("biggest risk", "main risk", "highest risk")),
    ("next_action", ("what should", "recommend", "next action", "do next")),
    ("why_flagged", ("why", "flagged", "suspicious")),
    ("transaction_value", ("revenue", "money", "transaction value", "sales")),
    ("data_quality", ("quality", "missing", "duplicate", "clean")),
    ("model", ("model", "accuracy", "precision", "recall", "f1", "auc")),
    ("segment", ("customers", "segments", "segment")),
)
# --- fixed values: answer texts ---
# {name} marks a fact put in by the operator
ANSWERS = {
    "empty": "Ask about risk, suspicious records, transaction value, data quality, model performance, "
             "or next actions.",
    "fallback": "Review the governed metric definitions, resolve dataset issues, inspect versioned rule evidence, "
                "and use the accessible report for a traceable summary.",
    "biggest_risk": "The biggest risk is {category}, with {count} records requiring review.{caveat}",
    "biggest_risk_none": "The versioned rule run found no suspicious records. Source: {ruleset}; dataset: {dataset}. "
                         "Validate the rules against reviewed examples before treating this as low risk.{caveat}",
    "next_action": "Review high-priority rule records first, verify duplicate or abnormal evidence, and send "
                   "loan-to-income pressure cases to an authorized reviewer.",
    "next_action_none": "Review the versioned rule coverage and collect authoritative outcomes before changing "
                        "lending limits.",
    "why_flagged": "{transaction} was flagged because {notes}.{caveat}",
    "why_flagged_none": "No records are currently flagged by the attached versioned run. Its rules evaluate unusually "
                        "high amounts, duplicate identifiers, spending spikes, repayment patterns, and profile "
                        "mismatches.{caveat}",
    "transaction_value": "Total transaction value is {total}, with an average of {average}. This is transaction "
                         "value, not recognized revenue. Definition: {definition}; source: {dataset}.",
    "data_quality": "The composite data quality score is {score}% ({status}). I found {missing} missing values and "
                    "{duplicates} duplicate rows. Review the six quality dimensions because a composite score never "
                    "overrides a blocking issue.",
    "model_none": "Train the demonstration model first, then I can summarize accuracy, precision, recall, F1-score, "
                  "and ROC-AUC.",
    "model": "On the final holdout, the demonstration model scored {accuracy} accuracy, {precision} precision, "
             "{recall} recall, {f1_score} F1-score, {roc_auc} ROC-AUC, and {pr_auc} PR-AUC. Its output is "
             "uncalibrated, the model is unapproved, and every score requires human review.",
    "segment": "The largest customer segment is {segment}, and total unique customers are {customers}.",
    "segment_none": "The dataset contains {customers} unique customers.",
    "unavailable": "{label} is unavailable: {reason} Recovery: {recovery}",
    "caveat": " Coverage caveat: {count} record-rule evaluations were not evaluated because required evidence was "
              "missing or invalid.",
}
# --- fixed values: narrative texts built from metric rows and from the older KPI record ---
METRIC_NARRATIVES = {
    "quality": "Composite data quality is {value}% ({status}); review the six dimensions and blocking issues before "
               "relying on it.",
    "available": "{label} is {value} ({status}).{qualification} Definition: {definition}.",
    "not_revenue": " This is not recognized revenue.",
}
KPI_NARRATIVES = {
    "top_segment": "{segment} is the strongest customer segment by total transaction value.",
    "suspicious_high": "Suspicious activity is high enough to justify manual review before approvals.",
    "suspicious_some": "A focused review of flagged records would reduce operational and credit risk.",
    "suspicious_none": "No suspicious records were flagged by the current rule set.",
    "repayment_high": "The repayment profile is healthy, with most customers marked as repaid.",
    "repayment_mid": "Repayment performance is moderate; risk checks should stay active.",
    "repayment_low": "Repayment performance is weak and approval rules should be tightened.",
    "quality_low": "Data quality issues may affect model confidence; clean missing and duplicate records.",
    "quality_ok": "The dataset quality score is strong enough for dashboard and model exploration.",
    "model_f1": "The selected model reached an F1-score of {f1} on the test split.",
    "model_auc": "The ROC-AUC score is {auc}, which helps show measurable model performance.",
    "top_pattern": "The most common suspicious pattern is {category}.",
    "rule_coverage": "Rule evidence coverage is {evaluated} of {possible} record-rule evaluations under {ruleset}; "
                     "non-evaluated rules are not clear results.",
}

# --- fixed values: CSV cells read as missing by the typed reader, and file limits ---
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILE_ROWS = 100_000
MAX_FILE_COLUMNS = 200
DELIMITERS = (",", ";", "\t", "|")
DELIMITER_SAMPLE = 65_536
NORMALIZATION_VERSION = "1"
