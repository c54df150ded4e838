"""Named data-quality queries (Q01-Q17) and their oracle SQL."""

from __future__ import annotations

from churnscope.functions.numeric import (
    count_if_sql,
    mean_sql,
    money_mean_sql,
    money_sum_sql,
    pct_sql,
    round_money_sql,
    round_to_sql,
)
from churnscope.functions.schemas import RAW_SCHEMA, TYPED_BOOLEANS, SERVICE_COLS
from churnscope.operators import quality
from churnscope.plans.oracle_base import _WS_SQL
from churnscope.plans.registry import query
from churnscope.sources import io
from churnscope.sources.accounts import orphan_orders


def _profile_sql() -> str:
    parts = []
    n = len(RAW_SCHEMA.fields)
    for i, f in enumerate(RAW_SCHEMA.fields):
        is_str = f.dataType.simpleString() == "string"
        blank = (
            count_if_sql(f"trim({f.name}, {_WS_SQL}) = ''")
            if is_str
            else "CAST(0 AS BIGINT)"
        )
        parts.append(
            f"SELECT '{f.name}' AS column_name, CAST({i + 1} AS INTEGER) AS position, "
            f"'{f.dataType.simpleString()}' AS data_type, "
            f"CAST(COUNT(*) - COUNT({f.name}) AS BIGINT) AS null_count, {blank} AS blank_count, "
            f"CAST(COUNT(*) AS BIGINT) AS total_rows, CAST({n} AS INTEGER) AS total_columns FROM raw_accounts"
        )
    return " UNION ALL ".join(parts)


@query("dq_profile", _profile_sql(), ("Q01",))
def dq_profile(fr):
    return quality.profile(fr.raw)


def _completeness_sql() -> str:
    """One aggregate, its columns turned into rows."""
    null_counts = ", ".join(f"CAST(COUNT(*) - COUNT({c}) AS VARCHAR) AS n_{c}" for c in quality.COMPLETENESS_COLUMNS)
    pairs = [("Total rows", "total", "Expected > 0"), *[(f"Null {c}", f"n_{c}", "Expected 0") for c in quality.COMPLETENESS_COLUMNS]]
    rows = ", ".join(f"{{'check_name': '{name}', 'result': {c}, 'note': '{note}'}}" for name, c, note in pairs)
    return f"SELECT UNNEST([{rows}], recursive := true) FROM (SELECT CAST(COUNT(*) AS VARCHAR) AS total, {null_counts} FROM customers) w"


@query("dq_completeness", _completeness_sql(), ("Q02",))
def dq_completeness(fr):
    return quality.completeness(fr.acct)


@query(
    "dq_duplicates",
    "SELECT 'Duplicate customer IDs' AS check_name, "
    "CAST(COUNT(*) - COUNT(DISTINCT customer_id) AS BIGINT) AS duplicate_count, "
    "'Expected 0' AS note FROM customers",
    ("Q03",),
)
def dq_duplicates(fr):
    return quality.duplicate_ids(fr.acct)


VALUE_FIELDS = {
    "Contract types": "contract",
    "Internet service": "internet_service",
    "Payment methods": "payment_method",
    "Gender": "gender",
}


def _value_counts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS field, {c} AS value, CAST(COUNT(*) AS BIGINT) AS count FROM customers GROUP BY {c}"
        for label, c in VALUE_FIELDS.items()
    )


@query("dq_value_counts", _value_counts_sql(), ("Q04",))
def dq_value_counts(fr):
    return quality.value_counts(fr.acct, VALUE_FIELDS)


@query(
    "dq_ranges",
    "SELECT CAST(MIN(monthly_charges) AS DOUBLE) AS min_monthly, CAST(MAX(monthly_charges) AS DOUBLE) AS max_monthly, "
    f"{round_to_sql(money_mean_sql('monthly_charges'), 2)} AS avg_monthly, "
    "CAST(MIN(total_charges) AS DOUBLE) AS min_total, CAST(MAX(total_charges) AS DOUBLE) AS max_total, "
    "MIN(tenure) AS min_tenure, MAX(tenure) AS max_tenure FROM customers",
    ("Q05",),
)
def dq_ranges(fr):
    return quality.numeric_ranges(fr.acct)


_ADDON_FLAGS = [TYPED_BOOLEANS[c] for c in SERVICE_COLS]
_NO_INTERNET_WITH_ADDON = "internet_service = 'No' AND (" + " OR ".join(_ADDON_FLAGS) + ")"


@query(
    "dq_business_rules",
    f"SELECT {count_if_sql('monthly_charges = 0 AND tenure > 0')} AS suspicious_zero_charge_customers, "
    f"{count_if_sql(_NO_INTERNET_WITH_ADDON)} "
    "AS addons_without_internet FROM customers",
    ("Q06", "Q07"),
)
def dq_business_rules(fr):
    return quality.business_rules(fr.acct, _ADDON_FLAGS)


@query(
    "dq_summary",
    "SELECT CAST(COUNT(*) AS BIGINT) AS total_customers, CAST(SUM(churn_flag) AS BIGINT) AS churned_customers, "
    "CAST(COUNT(*) - SUM(churn_flag) AS BIGINT) AS retained_customers, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 2)} AS overall_churn_pct, "
    f"{round_money_sql(money_sum_sql('monthly_charges'), 0)} AS total_mrr, "
    f"{round_money_sql(money_sum_sql('CASE WHEN churn_flag = 1 THEN monthly_charges END'), 0)} AS mrr_lost_to_churn, "
    f"{pct_sql('SUM(CASE WHEN churn_flag = 1 THEN CAST(monthly_charges AS DECIMAL(12,2)) END)', 'SUM(CAST(monthly_charges AS DECIMAL(12,2)))', 2)} "
    "AS revenue_churn_pct FROM customers",
    ("Q09",),
)
def dq_summary(fr):
    return quality.summary(fr.acct)


@query(
    "dq_sanity",
    "SELECT CAST(COUNT(*) AS BIGINT) AS total_customers, CAST(SUM(churn_flag) AS BIGINT) AS total_churned, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 2)} AS churn_rate_pct, "
    f"{round_to_sql(money_mean_sql('monthly_charges'), 2)} AS avg_monthly_charge, "
    f"{round_to_sql(mean_sql('tenure'), 1)} AS avg_tenure_months FROM customers",
    ("Q10",),
)
def dq_sanity(fr):
    return quality.sanity(fr.acct)


def _assertions_sql() -> str:
    all_null = " AND ".join(
        f"{c} IS NULL"
        for c in (
            "customer_id gender senior_citizen partner dependents tenure phone_service multiple_lines "
            "internet_service online_security online_backup device_protection tech_support streaming_tv "
            "streaming_movies contract paperless_billing payment_method monthly_charges total_charges churn churn_flag"
        ).split()
    )
    dupes = (
        "CAST(COUNT(*) - COUNT(DISTINCT customer_id) "
        "- COALESCE(MAX(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT)"
    )
    rules = [
        ("duplicate_customer_ids", dupes, 0, "NULL"),
        ("churn_flag_not_binary", count_if_sql("NOT COALESCE(churn_flag IN (0, 1), FALSE)"), 0, "NULL"),
        ("negative_tenure", count_if_sql("tenure < 0"), 0, "NULL"),
        ("negative_monthly_charges", count_if_sql("monthly_charges < 0"), 0, "NULL"),
        ("monthly_charges_over_200", count_if_sql("monthly_charges > 200"), 0, "'max=' || CAST(MAX(monthly_charges) AS VARCHAR)"),
        ("total_below_90pct_of_monthly", count_if_sql("total_charges < monthly_charges * 0.9"), 20, "NULL"),
        ("all_null_rows", count_if_sql(all_null), 0, "NULL"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule, {v} AS violations, CAST({t} AS BIGINT) AS threshold, "
        f"({v}) <= {t} AS passed, CAST({d} AS VARCHAR) AS detail FROM clean"
        for r, v, t, d in rules
    )


@query("dq_assertions", _assertions_sql(), ("Q11", "Q12", "Q13", "Q14", "Q15", "Q16", "Q17"))
def dq_assertions(fr):
    return quality.assertions(fr.clean)


@query("dq_on_write", _assertions_sql(), ("Q11", "Q12", "Q13", "Q14", "Q15", "Q16", "Q17", "IO06"))
def dq_on_write(fr):
    """The rule table measured by the job that writes the clean accounts."""
    rules, _ = io.save_checked(fr.clean, io.scratch_dir(fr.spark, "checked"), "clean")
    return rules


@query(
    "dq_orphan_orders",
    "SELECT CAST(COUNT(*) AS BIGINT) AS orders, "
    f"{count_if_sql('o_custkey IS NULL')} AS without_customer_key, "
    f"{count_if_sql('o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)')} "
    "AS customer_row_missing FROM orders o",
    ("IO03",),
)
def dq_orphan_orders(fr):
    """Orders that became accounts without customer data."""
    return orphan_orders(fr.spark, fr.sf_dir)
