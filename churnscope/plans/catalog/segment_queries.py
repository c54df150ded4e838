"""Named segment queries (SG01-SG14, Q08, CH07) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.functions.numeric import (
    count_if,
    money_mean,
    money_mean_sql,
    money_sum,
    money_sum_sql,
    round_money,
    round_money_sql,
    mean_sql,
    pct,
    pct_sql,
    ratio,
    ratio_sql,
    round_to,
    round_to_sql,
)
from churnscope.functions.schemas import (
    BENCHMARK_CHURN_PCT,
    CONTRACT_M2M,
    CONTRACT_TWO,
    INTERNET_FIBER,
    INTERNET_VALUES,
    PAY_ECHECK,
    TENURE_LABELS_SQL,
    TIER_AT_RISK,
    TIER_HEALTHY,
)
from churnscope.operators.segments import (
    avg_charges,
    avg_tenure,
    conditional_rates,
    n_rows,
    pivot_mean,
    segment_churn,
    top_segments,
)
from churnscope.plans.registry import query

CHURN_SQL = (
    "CAST(COUNT(*) AS BIGINT) AS total_customers, "
    "CAST(SUM(churn_flag) AS BIGINT) AS churned, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 1)} AS churn_rate_pct"
)
AVG_TENURE_SQL = f"{round_to_sql(mean_sql('tenure'), 1)} AS avg_tenure_months"
AVG_CHARGES_SQL = f"{round_to_sql(money_mean_sql('monthly_charges'), 2)} AS avg_monthly_charges"


@query(
    "churn_by_contract",
    f"SELECT contract, {CHURN_SQL}, {AVG_TENURE_SQL}, {AVG_CHARGES_SQL} FROM customers GROUP BY contract",
    ("SG01", "Q08", "CH02"),
)
def churn_by_contract(fr):
    return segment_churn(fr.acct, ["contract"], [avg_tenure(), avg_charges()]).orderBy(
        F.col("churn_rate_pct").desc(), "contract"
    )


@query(
    "churn_by_internet",
    f"SELECT internet_service, {CHURN_SQL}, {AVG_CHARGES_SQL} FROM customers GROUP BY internet_service",
    ("SG02",),
)
def churn_by_internet(fr):
    return segment_churn(fr.acct, ["internet_service"], [avg_charges()]).orderBy(
        F.col("churn_rate_pct").desc(), "internet_service"
    )


@query(
    "churn_by_payment",
    f"SELECT payment_method, is_autopay, {CHURN_SQL} FROM customers GROUP BY payment_method, is_autopay",
    ("SG03",),
)
def churn_by_payment(fr):
    return segment_churn(fr.acct, ["payment_method", "is_autopay"]).orderBy(
        F.col("churn_rate_pct").desc(), "payment_method"
    )


def _bucket_order_sql(c: str) -> str:
    whens = " ".join(f"WHEN '{label}' THEN {i + 1}" for i, label in enumerate(TENURE_LABELS_SQL))
    return f"CASE {c} {whens} END"


@query(
    "churn_by_tenure_bucket",
    f"SELECT tenure_bucket, {CHURN_SQL}, {AVG_CHARGES_SQL}, "
    f"{_bucket_order_sql('tenure_bucket')} AS lifecycle_order FROM customers GROUP BY tenure_bucket",
    ("SG04",),
)
def churn_by_tenure_bucket(fr):
    order = None
    for i, label in enumerate(TENURE_LABELS_SQL):
        cond = F.col("tenure_bucket") == label
        order = F.when(cond, i + 1) if order is None else order.when(cond, i + 1)
    return (
        segment_churn(fr.acct, ["tenure_bucket"], [avg_charges()])
        .withColumn("lifecycle_order", order)
        .orderBy(F.col("lifecycle_order").asc_nulls_last())
    )


@query(
    "churn_by_num_services",
    f"SELECT num_services, {CHURN_SQL}, {AVG_CHARGES_SQL} FROM customers GROUP BY num_services",
    ("SG05", "CH08"),
)
def churn_by_num_services(fr):
    return segment_churn(fr.acct, ["num_services"], [avg_charges()]).orderBy("num_services")


@query(
    "churn_contract_internet",
    f"SELECT contract, internet_service, {CHURN_SQL}, "
    f"{round_to_sql(money_mean_sql('monthly_charges'), 2)} AS avg_charges "
    "FROM customers GROUP BY contract, internet_service",
    ("SG06",),
)
def churn_contract_internet(fr):
    return segment_churn(
        fr.acct, ["contract", "internet_service"], [avg_charges(name="avg_charges")]
    ).orderBy(F.col("churn_rate_pct").desc(), "contract", "internet_service")


def _pivot_cols_sql() -> str:
    return ", ".join(
        f"{pct_sql(f'SUM(CASE WHEN internet_service = {chr(39)}{v}{chr(39)} THEN churn_flag END)', f'COUNT(CASE WHEN internet_service = {chr(39)}{v}{chr(39)} THEN 1 END)', 1)} AS \"{v}\""
        for v in INTERNET_VALUES
    )


@query(
    "pivot_contract_internet",
    f"SELECT contract, {_pivot_cols_sql()} FROM feat WHERE contract IS NOT NULL GROUP BY contract",
    ("SG07", "CH05"),
)
def pivot_contract_internet(fr):
    """Churn rate (%) by contract x internet service, wide; missing cells NULL."""
    df = fr.feat.where(F.col("contract").isNotNull())
    return pivot_mean(df, "contract", "internet_service", INTERNET_VALUES, pct(F.sum("churn_flag"), F.count(F.lit(1)), 1))


@query(
    "pivot_charges_internet_churn",
    "SELECT internet_service, "
    f"{round_to_sql(money_mean_sql('CASE WHEN churn_flag = 0 THEN monthly_charges END'), 2)} AS retained_avg_charges, "
    f"{round_to_sql(money_mean_sql('CASE WHEN churn_flag = 1 THEN monthly_charges END'), 2)} AS churned_avg_charges "
    "FROM feat WHERE internet_service IS NOT NULL GROUP BY internet_service",
    ("SG08",),
)
def pivot_charges_internet_churn(fr):
    df = fr.feat.where(F.col("internet_service").isNotNull())
    return pivot_mean(
        df,
        "internet_service",
        "churn_flag",
        [0, 1],
        round_to(money_mean("monthly_charges"), 2),
        ["retained_avg_charges", "churned_avg_charges"],
    )


@query(
    "risk_combos_top5",
    "SELECT contract, internet_service, payment_method, "
    f"{round_to_sql('rate * 100.0', 1)} AS churn_rate_pct, customers FROM ("
    "SELECT contract, internet_service, payment_method, CAST(COUNT(*) AS BIGINT) AS customers, "
    f"{ratio_sql('SUM(churn_flag)', 'COUNT(*)')} AS rate FROM feat "
    "WHERE contract IS NOT NULL AND internet_service IS NOT NULL AND payment_method IS NOT NULL "
    "GROUP BY contract, internet_service, payment_method HAVING COUNT(*) >= 30) t "
    "ORDER BY rate DESC, contract, internet_service, payment_method LIMIT 5",
    ("SG09",),
)
def risk_combos_top5(fr):
    return top_segments(fr.feat, ["contract", "internet_service", "payment_method"], 30, 5)


def _ratio_rows_sql() -> str:
    pairs = [
        ("contract", CONTRACT_M2M, CONTRACT_TWO, "contract"),
        ("health_tier", TIER_AT_RISK, TIER_HEALTHY, "health_tier"),
    ]
    parts = []
    for label, a, b, col in pairs:
        ra = pct_sql(f"SUM(CASE WHEN {col} = '{a}' THEN churn_flag ELSE 0 END)", f"SUM(CASE WHEN {col} = '{a}' THEN 1 ELSE 0 END)", 1)
        rb = pct_sql(f"SUM(CASE WHEN {col} = '{b}' THEN churn_flag ELSE 0 END)", f"SUM(CASE WHEN {col} = '{b}' THEN 1 ELSE 0 END)", 1)
        parts.append(
            f"SELECT '{label}' AS dimension, '{a}' AS group_a, '{b}' AS group_b, {ra} AS rate_a_pct, {rb} AS rate_b_pct FROM feat"
        )
    inner = " UNION ALL ".join(parts)
    return f"SELECT *, {round_to_sql(ratio_sql('rate_a_pct', 'rate_b_pct'), 2)} AS multiplier FROM ({inner}) r"


@query("churn_ratio", _ratio_rows_sql(), ("SG10",))
def churn_ratio(fr):
    """Churn multiplier between two groups, per dimension: M2M vs two-year
    contracts and At Risk vs Healthy tiers.  Rates are rounded to 1 dp
    first, as in the analysed notebook; one pass over the feature frame."""
    pairs = [
        ("contract", CONTRACT_M2M, CONTRACT_TWO, "contract"),
        ("health_tier", TIER_AT_RISK, TIER_HEALTHY, "health_tier"),
    ]
    conds = {}
    for i, (_, a, b, col) in enumerate(pairs):
        conds[f"p{i}a"] = F.col(col) == a
        conds[f"p{i}b"] = F.col(col) == b
    wide = conditional_rates(fr.feat, conds)
    rows = [
        F.struct(
            F.lit(label).alias("dimension"),
            F.lit(a).alias("group_a"),
            F.lit(b).alias("group_b"),
            pct(F.col(f"p{i}a_churned"), F.col(f"p{i}a_n"), 1).alias("rate_a_pct"),
            pct(F.col(f"p{i}b_churned"), F.col(f"p{i}b_n"), 1).alias("rate_b_pct"),
        )
        for i, (label, a, b, _) in enumerate(pairs)
    ]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.withColumn("multiplier", round_to(ratio("rate_a_pct", "rate_b_pct"), 2))


@query(
    "retention_by_band",
    "SELECT tenure_bucket, CAST(COUNT(*) AS BIGINT) AS total_customers, "
    "CAST(SUM(1 - churn_flag) AS BIGINT) AS retained, "
    f"{pct_sql('SUM(1 - churn_flag)', 'COUNT(*)', 1)} AS retention_rate_pct "
    "FROM customers GROUP BY tenure_bucket",
    ("SG11",),
)
def retention_by_band(fr):
    retained = F.sum(1 - F.col("churn_flag"))
    return fr.acct.groupBy("tenure_bucket").agg(
        n_rows().alias("total_customers"),
        retained.cast("bigint").alias("retained"),
        pct(retained, F.count(F.lit(1)), 1).alias("retention_rate_pct"),
    )


@query(
    "churn_by_service_depth",
    f"SELECT service_depth, {CHURN_SQL} FROM feat WHERE service_depth IS NOT NULL GROUP BY service_depth",
    ("SG12",),
)
def churn_by_service_depth(fr):
    return segment_churn(fr.feat, ["service_depth"], drop_null_keys=True)


@query(
    "benchmark_gap",
    f"SELECT {pct_sql('SUM(churn_flag)', 'COUNT(*)', 1)} AS churn_rate_pct, "
    f"CAST({BENCHMARK_CHURN_PCT} AS DOUBLE) AS benchmark_pct, "
    f"{round_to_sql(pct_sql('SUM(churn_flag)', 'COUNT(*)', 1) + f' - {BENCHMARK_CHURN_PCT}', 1)} AS gap_pct_points "
    "FROM customers",
    ("SG13",),
)
def benchmark_gap(fr):
    rate = pct(F.sum("churn_flag"), F.count(F.lit(1)), 1)
    return fr.acct.agg(rate.alias("churn_rate_pct")).select(
        "churn_rate_pct",
        F.lit(BENCHMARK_CHURN_PCT).cast("double").alias("benchmark_pct"),
        round_to(F.col("churn_rate_pct") - BENCHMARK_CHURN_PCT, 1).alias("gap_pct_points"),
    )


_PROFILE_SQL = (
    f"contract = '{CONTRACT_M2M}' AND internet_service = '{INTERNET_FIBER}' "
    f"AND payment_method = '{PAY_ECHECK}' AND NOT has_tech_support"
)


@query(
    "risk_profile_stats",
    "SELECT CAST(COUNT(*) AS BIGINT) AS profile_customers, "
    "CAST(COALESCE(SUM(churn_flag), 0) AS BIGINT) AS churned, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 1)} AS churn_rate_pct, "
    "CAST(COALESCE(SUM(CASE WHEN churn_flag = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS active_customers, "
    f"{round_money_sql(money_sum_sql('CASE WHEN churn_flag = 0 THEN monthly_charges END'), 0)} AS active_mrr "
    f"FROM customers WHERE {_PROFILE_SQL}",
    ("SG14",),
)
def risk_profile_stats(fr):
    """The riskiest profile (M2M + fiber + e-check + no tech support)."""
    df = fr.acct.where(
        (F.col("contract") == CONTRACT_M2M)
        & (F.col("internet_service") == INTERNET_FIBER)
        & (F.col("payment_method") == PAY_ECHECK)
        & ~F.col("has_tech_support")
    )
    active = F.col("churn_flag") == 0
    return df.agg(
        n_rows().alias("profile_customers"),
        F.coalesce(F.sum("churn_flag"), F.lit(0)).cast("bigint").alias("churned"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
        count_if(active).alias("active_customers"),
        round_money(money_sum(F.when(active, F.col("monthly_charges"))), 0).alias("active_mrr"),
    )


@query(
    "chart_payment",
    "SELECT payment_method, CAST(COUNT(*) AS BIGINT) AS customers, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 1)} AS churn_rate_pct, "
    f"({ratio_sql('SUM(churn_flag) * 100.0', 'COUNT(*)')} > 30) AS above_30_pct "
    "FROM feat WHERE payment_method IS NOT NULL GROUP BY payment_method",
    ("CH07",),
)
def chart_payment(fr):
    """Data of the payment-method bar chart: rate, size, flag when > 30 %."""
    df = fr.feat.where(F.col("payment_method").isNotNull())
    return (
        df.groupBy("payment_method")
        .agg(
            n_rows().alias("customers"),
            pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
            (ratio(F.sum("churn_flag").cast("double") * 100.0, F.count(F.lit(1))) > 30).alias("above_30_pct"),
        )
        .orderBy("churn_rate_pct", "payment_method")
    )


@query(
    "chart_overview",
    "SELECT CAST(COUNT(*) AS BIGINT) AS total_customers, CAST(SUM(churn_flag) AS BIGINT) AS churned, "
    "CAST(COUNT(*) - SUM(churn_flag) AS BIGINT) AS retained, "
    f"{pct_sql('SUM(churn_flag)', 'COUNT(*)', 1)} AS churn_rate_pct, "
    f"{pct_sql('COUNT(*) - SUM(churn_flag)', 'COUNT(*)', 1)} AS retained_rate_pct FROM feat",
    ("CH01",),
)
def chart_overview(fr):
    churned = F.sum("churn_flag")
    total = F.count(F.lit(1))
    return fr.feat.agg(
        n_rows().alias("total_customers"),
        churned.cast("bigint").alias("churned"),
        (total - churned).cast("bigint").alias("retained"),
        pct(churned, total, 1).alias("churn_rate_pct"),
        pct(total - churned, total, 1).alias("retained_rate_pct"),
    )

