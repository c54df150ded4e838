"""Ordered-set aggregates, cohorts and windows (CO01-CO07).

* Global scalars (the median charge) are constants that ``selection`` finds when
  the query is built, never a join.
* Top-k lists are ``orderBy().limit()`` (TakeOrderedAndProject: each task
  keeps its own top k; only k rows per task reach the final merge).
* Top-n per group filters ``row_number`` so Spark plans WindowGroupLimit
  before the shuffle; the group sizes come from a separate partial
  aggregation joined to the few surviving rows.
* Running and share-of-total windows run on aggregated rows only (one row
  per tenure month or per cohort cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.numeric import mean, money_mean, money_sum, pct, round_money, round_to
from churnscope.functions.schemas import CONTRACT_M2M, INTERNET_FIBER, PAY_ECHECK
from churnscope.operators.ranking import top_n_per_group
from churnscope.operators.selection import quantile_values, quantiles


def median_of(df: DataFrame, c: str) -> Column:
    """Median (exact, linear interpolation) as a constant, 6 places."""
    value = quantile_values(df, [c], [0.5]).get((0, c, 0.5))
    return round_to(F.lit(value).cast("double"), 6)


def high_value_churners(acct: DataFrame) -> DataFrame:
    """CO01: churned accounts above the overall median charge: size, average
    charge, lost revenue, average tenure, and the most common contract and
    payment method (ties: the first in sort order)."""
    median = median_of(acct, "monthly_charges")
    hv = acct.where((F.col("churn_flag") == 1) & (F.col("monthly_charges") > median))
    return hv.agg(
        F.count(F.lit(1)).cast("bigint").alias("high_value_churners"),
        round_to(money_mean("monthly_charges"), 2).alias("avg_monthly_charges"),
        round_money(money_sum("monthly_charges"), 0).alias("total_monthly_revenue_lost"),
        round_to(mean("tenure"), 1).alias("avg_tenure_months"),
        F.mode("contract", deterministic=True).alias("most_common_contract"),
        F.mode("payment_method", deterministic=True).alias("most_common_payment"),
    )


LOOKALIKE_COLUMNS = [
    "customer_id",
    "tenure",
    "monthly_charges",
    "internet_service",
    "contract",
    "payment_method",
    "has_tech_support",
    "num_services",
]


def lookalike_actives(acct: DataFrame, n: int = 50) -> DataFrame:
    """CO02: active accounts with the churners' profile, top ``n`` by charge."""
    cond = (
        (F.col("churn_flag") == 0)
        & (F.col("contract") == CONTRACT_M2M)
        & (F.col("internet_service") == INTERNET_FIBER)
        & (F.col("payment_method") == PAY_ECHECK)
        & (F.col("has_tech_support") == F.lit(False))
        & (F.col("tenure") < 12)
    )
    return (
        acct.where(cond)
        .select(*LOOKALIKE_COLUMNS)
        .orderBy(F.col("monthly_charges").desc(), "customer_id")
        .limit(n)
        .withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
    )


def tenure_curve(acct: DataFrame) -> DataFrame:
    """CO03 + CO03b: per tenure month, size, churned, churn rate, the
    cumulative share of customers with tenure <= t, and the share with
    tenure >= t (the survival share)."""
    per_month = acct.groupBy(F.col("tenure").alias("months_active")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_at_tenure"),
        F.sum("churn_flag").cast("bigint").alias("churned_at_tenure"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 2).alias("churn_rate_pct"),
    )
    running = F.sum("total_at_tenure").over(
        Window.orderBy(F.col("months_active").asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    total = F.sum("total_at_tenure").over(Window.partitionBy())
    return per_month.select(
        "months_active",
        "total_at_tenure",
        "churned_at_tenure",
        "churn_rate_pct",
        pct(running, total, 2).alias("cumulative_customer_pct"),
        pct(total - running + F.col("total_at_tenure"), total, 2).alias("share_with_tenure_ge"),
    ).orderBy("months_active")


def cohort_contract(acct: DataFrame) -> DataFrame:
    """CO04: tenure band x contract with the cell's share of all churn."""
    cells = acct.groupBy("tenure_bucket", "contract").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.sum("churn_flag").cast("bigint").alias("churned"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
    )
    all_churn = F.sum("churned").over(Window.partitionBy())
    return cells.withColumn("pct_of_total_churn", pct(F.col("churned"), all_churn, 1)).orderBy(
        F.col("churn_rate_pct").desc(), "tenure_bucket", "contract"
    )


RISK_RANK_COLUMNS = [
    "customer_id",
    "contract",
    "tenure",
    "monthly_charges",
    "num_services",
    "is_autopay",
    "has_tech_support",
    "churn_flag",
]


def risk_rank(acct: DataFrame, n: int = 10) -> DataFrame:
    """CO05: the ``n`` riskiest active accounts per contract (highest charge,
    fewest services, shortest tenure; id breaks ties) with the group size."""
    actives = acct.where(F.col("churn_flag") == 0).select(*RISK_RANK_COLUMNS)
    top = top_n_per_group(
        actives,
        ["contract"],
        [F.col("monthly_charges").desc(), F.col("num_services").asc(), F.col("tenure").asc(), "customer_id"],
        n,
        "risk_rank_in_contract",
    )
    sizes = actives.groupBy("contract").agg(F.count(F.lit(1)).cast("bigint").alias("contract_group_size"))
    return (
        top.join(sizes, top.contract.eqNullSafe(sizes.contract), "inner")
        .select(top["*"], sizes.contract_group_size)
        .withColumn("risk_rank_in_contract", F.col("risk_rank_in_contract").cast("int"))
        .withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
        .orderBy("contract", "risk_rank_in_contract")
    )


def group_medians(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """CO06: medians per group (exact linear interpolation), 6 places."""
    known = df.where(F.col(key).isNotNull())
    sizes = known.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("customers"))
    medians = quantiles(known, cols, [0.5], key).groupBy(key).agg(
        *[round_to(F.max(F.when(F.col("name") == c, F.col("value"))), 6).alias(f"median_{c}") for c in cols]
    )
    return sizes.join(medians, key, "left")
