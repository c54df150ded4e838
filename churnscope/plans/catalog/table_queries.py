"""Named queries for the base tables and features (IO03, IO08, IO09, CL, FE).

Decimal money columns are returned as doubles in query results (the stored
tables keep ``decimal``); every value is exact cents either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from churnscope.operators.cleaning import cleaning_report
from churnscope.plans.registry import query


def decimals_as_double(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _raw_select_sql() -> str:
    from churnscope.functions.schemas import RAW_COLUMNS

    return ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" if c == "MonthlyCharges" else c for c in RAW_COLUMNS
    )


@query("raw_accounts", f"SELECT {_raw_select_sql()} FROM raw_accounts", ("IO03",))
def raw_accounts_q(fr):
    """The 21-column raw accounts, as a CSV export would hold them."""
    return decimals_as_double(fr.raw)


CLEAN_COLS_SQL = (
    "customer_id, gender, senior_citizen, partner, dependents, tenure, phone_service, "
    "multiple_lines, internet_service, online_security, online_backup, device_protection, "
    "tech_support, streaming_tv, streaming_movies, contract, paperless_billing, payment_method, "
    "monthly_charges, total_charges, churn, churn_flag"
)


@query("clean_accounts", f"SELECT {CLEAN_COLS_SQL} FROM clean", ("CL01", "CL02", "CL03", "CL04", "CL06", "CL12"))
def clean_accounts(fr):
    return fr.clean


@query(
    "accounts_typed",
    "SELECT * REPLACE (CAST(monthly_charges AS DOUBLE) AS monthly_charges, "
    "CAST(total_charges AS DOUBLE) AS total_charges) FROM customers",
    ("IO08", "CL05", "CL07", "CL08", "CL09", "CL10"),
)
def accounts_typed(fr):
    return decimals_as_double(fr.acct)


_REPORT_SQL = """
SELECT metric, value FROM (
    SELECT 'columns_renamed' AS metric, 21.0 AS value
    UNION ALL SELECT 'total_charges_imputed', CAST(SUM(CASE WHEN total_text IS NULL OR total_text = '' THEN 1 ELSE 0 END) AS DOUBLE) FROM clean
    UNION ALL SELECT 'total_charges_nulls_after_coerce', CAST(SUM(CASE WHEN total_charges IS NULL THEN 1 ELSE 0 END) AS DOUBLE) FROM clean
    UNION ALL SELECT 'churn_rate_pct', {rate} FROM clean
    UNION ALL SELECT 'churned_count', CAST(SUM(churn_flag) AS DOUBLE) FROM clean
    UNION ALL SELECT 'retained_count', CAST(SUM(CASE WHEN churn_flag = 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM clean
    UNION ALL SELECT 'total_rows', CAST(COUNT(*) AS DOUBLE) FROM clean
    UNION ALL SELECT 'total_cols', 22.0
    {nulls}
) m WHERE metric NOT LIKE 'nulls.%' OR value > 0
"""


def _report_sql() -> str:
    from churnscope.functions.numeric import pct_sql

    cols = [c.strip() for c in CLEAN_COLS_SQL.split(",")]
    nulls = "\n    ".join(
        f"UNION ALL SELECT 'nulls.{c}', CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) FROM clean"
        for c in cols
    )
    return _REPORT_SQL.format(rate=pct_sql("SUM(churn_flag)", "COUNT(*)", 2), nulls=nulls)


@query("cleaning_report", _report_sql(), ("CL11",))
def cleaning_report_q(fr):
    return cleaning_report(fr.raw)


FEATURE_GROUPS = {
    "feat_tenure": ("FE01", "FE02", "FE03"),
    "feat_services": ("FE04", "FE05", "FE06", "FE07"),
    "feat_billing": ("FE08", "FE09", "FE10", "FE11", "FE12"),
    "feat_encodings": ("FE13", "FE18", "FE19", "FE20"),
    "feat_health": ("FE21", "FE22"),
}
FEATURE_COLUMNS = {
    "feat_tenure": ["tenure", "tenure_bucket", "is_new_customer", "tenure_normalized"],
    "feat_services": ["num_services", "has_any_security", "is_streaming_only", "service_depth"],
    "feat_billing": [
        "monthly_charges",
        "charge_per_service",
        "charge_consistency_ratio",
        "is_high_spender",
        "is_autopay",
        "is_electronic_check",
    ],
    "feat_encodings": [
        "partner_flag",
        "dependents_flag",
        "phone_service_flag",
        "paperless_billing_flag",
        "senior_citizen_flag",
        "contract_ordinal",
        "has_internet",
        "has_fiber",
    ],
    "feat_health": ["health_score", "health_tier"],
}


def _register_feature_group(name: str) -> None:
    cols = ["customer_id"] + FEATURE_COLUMNS[name]

    def build(fr):
        return fr.feat.select(*cols)

    build.__doc__ = f"Feature group {name}: {', '.join(FEATURE_COLUMNS[name])}."
    query(name, f"SELECT {', '.join(cols)} FROM feat", FEATURE_GROUPS[name])(build)


for _name in FEATURE_GROUPS:
    _register_feature_group(_name)


@query("features_all", "SELECT * FROM feat", ("FE23",))
def features_all(fr):
    return fr.feat


@query(
    "health_scores",
    "SELECT * REPLACE (CAST(monthly_charges AS DOUBLE) AS monthly_charges) FROM scores",
    ("IO09", "HS01", "CO07"),
)
def health_scores(fr):
    """The scored table: three global quintiles, 0-dp score and tier."""
    return decimals_as_double(fr.scored_full())
