"""Schemas, label sets and decision tables.

Everything below the FIXED VALUES marker must equal the values of the
analysed project for results to match: column names, category labels,
band edges, point weights and thresholds.  They are stated once here and
used to generate column expressions everywhere else.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the analysed project's; do not edit)
# --------------------------------------------------------------------------

# Raw export column name -> clean snake_case name, in file order.
RAW_TO_CLEAN: dict[str, str] = {
    "customerID": "customer_id",
    "gender": "gender",
    "SeniorCitizen": "senior_citizen",
    "Partner": "partner",
    "Dependents": "dependents",
    "tenure": "tenure",
    "PhoneService": "phone_service",
    "MultipleLines": "multiple_lines",
    "InternetService": "internet_service",
    "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "TechSupport": "tech_support",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
    "Contract": "contract",
    "PaperlessBilling": "paperless_billing",
    "PaymentMethod": "payment_method",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "Churn": "churn",
}

# The six add-on services, and the four "security-type" ones among them.
SERVICE_COLS = [
    "online_security",
    "online_backup",
    "device_protection",
    "tech_support",
    "streaming_tv",
    "streaming_movies",
]
SECURITY_COLS = ["online_security", "online_backup", "device_protection", "tech_support"]
STREAMING_COLS = ["streaming_tv", "streaming_movies"]

# Yes/No columns turned into <name>_flag 0/1 integers (feature frame).
FLAG_COLS = ["partner", "dependents", "phone_service", "paperless_billing", "senior_citizen"]

# Yes/No columns turned into booleans in the typed accounts table.
TYPED_BOOLEANS = {
    "partner": "has_partner",
    "dependents": "has_dependents",
    "phone_service": "has_phone",
    "multiple_lines": "has_multi_lines",
    "online_security": "has_online_security",
    "online_backup": "has_online_backup",
    "device_protection": "has_device_protection",
    "tech_support": "has_tech_support",
    "streaming_tv": "has_streaming_tv",
    "streaming_movies": "has_streaming_movies",
    "paperless_billing": "paperless_billing",
}

CONTRACT_M2M = "Month-to-month"
CONTRACT_ONE = "One year"
CONTRACT_TWO = "Two year"
CONTRACTS = [CONTRACT_M2M, CONTRACT_ONE, CONTRACT_TWO]
CONTRACT_ORDINAL = {CONTRACT_M2M: 0, CONTRACT_ONE: 1, CONTRACT_TWO: 2}

INTERNET_DSL = "DSL"
INTERNET_FIBER = "Fiber optic"
INTERNET_NONE = "No"
INTERNET_VALUES = [INTERNET_DSL, INTERNET_FIBER, INTERNET_NONE]

PAY_ECHECK = "Electronic check"
PAY_MAILED = "Mailed check"
PAY_BANK = "Bank transfer (automatic)"
PAY_CARD = "Credit card (automatic)"
AUTOPAY_METHODS = [PAY_BANK, PAY_CARD]

# Tenure bands: inclusive month ranges, SQL labels, notebook labels, points.
TENURE_BANDS = [(0, 12), (13, 24), (25, 48), (49, 72)]
TENURE_LABELS_SQL = ["0-12 months", "13-24 months", "25-48 months", "49-72 months"]
TENURE_LABELS_PY = ["0-12m", "13-24m", "25-48m", "49-72m"]
TENURE_POINTS = [10, 25, 40, 50]

# Health points: contract, per service, auto-pay, tech support; maximum raw.
CONTRACT_POINTS = {CONTRACT_M2M: 5, CONTRACT_ONE: 15, CONTRACT_TWO: 25}
POINTS_PER_SERVICE = 3
AUTOPAY_POINTS = 7
TECH_SUPPORT_POINTS = 5
MAX_RAW_POINTS = 105

# Tiers.  SQL score (0 dp): >= 70 Healthy, >= 40 Needs Attention, else At Risk.
# Notebook score (1 dp): (-1,39] At Risk, (39,69] Needs Attention, (69,100] Healthy.
TIER_AT_RISK = "At Risk"
TIER_NEEDS = "Needs Attention"
TIER_HEALTHY = "Healthy"
TIERS = [TIER_AT_RISK, TIER_NEEDS, TIER_HEALTHY]

# Service-depth bands over num_services: (-1,0], (0,2], (2,4], (4,6].
SERVICE_DEPTH = [(0, 0, "None"), (1, 2, "Low (1-2)"), (3, 4, "Medium (3-4)"), (5, 6, "High (5-6)")]

# Add-on risk score on active accounts and its tiers.
RISK_TIERS = [(5, "Critical (5-7)"), (3, "High (3-4)"), (2, "Medium (2)")]
RISK_TIER_LOW = "Low (0-1)"

# Points of the add-on risk score: a condition (SQL text, both engines), points.
RISK_POINTS = [
    (f"contract = '{CONTRACT_M2M}'", 2),
    (f"internet_service = '{INTERNET_FIBER}'", 1),
    (f"payment_method = '{PAY_ECHECK}'", 1),
    ("NOT has_tech_support", 1),
    ("tenure < 12", 1),
    ("num_services <= 1", 1),
]

# Pareto quintile labels, quintile 1 = highest charges.
PARETO_LABELS = ["Top 20%", "20-40%", "40-60%", "60-80%", "Bottom 20%"]

# Intervention, priority and upsell rules.
INTERVENTION_RATES = [0.20, 0.35, 0.50]
SCENARIO_RATES = [0.10, 0.20, 0.35, 0.50]
ACTION_ANNUAL = "Offer annual contract discount"
ACTION_AUTOPAY = "Migration to auto-pay campaign"
ACTION_SUPPORT = "Upsell tech support bundle"
ACTION_CSM = "High-touch CSM outreach"
UPSELL_SUPPORT = "Tech Support"
UPSELL_AUTOPAY = "Auto-pay setup"
UPSELL_PREMIUM = "Premium plan upgrade"

# First matching condition (SQL text, both engines) gives the label.
ACTION_RULES = [
    (f"contract = '{CONTRACT_M2M}' AND monthly_charges > 70", ACTION_ANNUAL),
    ("NOT is_autopay", ACTION_AUTOPAY),
    ("NOT has_tech_support AND monthly_charges > 60", ACTION_SUPPORT),
    ("TRUE", ACTION_CSM),
]
UPSELL_RULES = [("NOT has_tech_support", UPSELL_SUPPORT), ("NOT is_autopay", UPSELL_AUTOPAY), ("TRUE", UPSELL_PREMIUM)]

# Industry churn benchmark (percent) used by the gap query and the chart line.
BENCHMARK_CHURN_PCT = 7.0

# Retention program portfolio (USD): program, target segment, cost, ARR
# recovered low and high.  Target sizes are counted from the data.
PROGRAMS = [
    ("M2M → Annual contract campaign", "M2M customers", 45000.0, 280000.0, 560000.0),
    ("Auto-pay migration campaign", "electronic check customers", 8000.0, 95000.0, 190000.0),
    ("Structured onboarding (0–90 day)", "All new customers", 60000.0, 150000.0, 300000.0),
    ("At-Risk CSM outreach program", "highest-risk active accounts", 120000.0, 200000.0, 400000.0),
]
PROGRAM_TOTAL = "Total"

# Contract-migration offer: minimum tenure, priority above this charge, discounts.
MIGRATION_MIN_TENURE = 3
MIGRATION_PRIORITY_CHARGE = 65
MIGRATION_DISCOUNTS = [0.10, 0.15]
# Outreach export: score below this, books of at most this many accounts.
OUTREACH_MAX_SCORE = 40
OUTREACH_BOOK_SIZE = 80
# Onboarding list: tenure at most this many months, fewer than this many services.
ONBOARDING_MAX_TENURE = 3
ONBOARDING_MAX_SERVICES = 2

# Features correlated with churn, in the notebook's order.
CORR_FEATURES = [
    "tenure",
    "monthly_charges",
    "total_charges",
    "num_services",
    "is_autopay",
    "is_electronic_check",
    "is_new_customer",
    "is_high_spender",
    "has_any_security",
    "contract_ordinal",
    "has_internet",
    "has_fiber",
    "partner_flag",
    "dependents_flag",
    "paperless_billing_flag",
    "health_score",
]

# Columns described by the feature summary, in order.
SUMMARY_FEATURES = [
    "tenure_bucket",
    "num_services",
    "service_depth",
    "charge_per_service",
    "is_autopay",
    "is_new_customer",
    "has_any_security",
    "health_score",
    "health_tier",
]
SUMMARY_CATEGORICAL = {"tenure_bucket", "service_depth", "health_tier"}

# --------------------------------------------------------------------------
# End of fixed values
# --------------------------------------------------------------------------

RAW_SCHEMA = StructType(
    [
        StructField("customerID", StringType()),
        StructField("gender", StringType()),
        StructField("SeniorCitizen", IntegerType()),
        StructField("Partner", StringType()),
        StructField("Dependents", StringType()),
        StructField("tenure", IntegerType()),
        StructField("PhoneService", StringType()),
        StructField("MultipleLines", StringType()),
        StructField("InternetService", StringType()),
        StructField("OnlineSecurity", StringType()),
        StructField("OnlineBackup", StringType()),
        StructField("DeviceProtection", StringType()),
        StructField("TechSupport", StringType()),
        StructField("StreamingTV", StringType()),
        StructField("StreamingMovies", StringType()),
        StructField("Contract", StringType()),
        StructField("PaperlessBilling", StringType()),
        StructField("PaymentMethod", StringType()),
        StructField("MonthlyCharges", DecimalType(8, 2)),
        StructField("TotalCharges", StringType()),
        StructField("Churn", StringType()),
    ]
)

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
CLEAN_COLUMNS = [RAW_TO_CLEAN[c] for c in RAW_COLUMNS]
