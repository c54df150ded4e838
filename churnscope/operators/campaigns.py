"""Score validation and outreach lists (HS02-HS10).

Lists with a size limit are top-k plans; the outreach export has no limit
and numbers every account in one global order, so it uses the distributed
``global_rank`` (range partitioning) instead of a single-partition window.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import count_if, mean, money_mean, money_sum, pct, ratio, round_money, round_to
from churnscope.functions.rules import first_match
from churnscope.functions.schemas import (
    ACTION_RULES,
    CONTRACT_M2M,
    MIGRATION_DISCOUNTS,
    MIGRATION_MIN_TENURE,
    MIGRATION_PRIORITY_CHARGE,
    ONBOARDING_MAX_SERVICES,
    ONBOARDING_MAX_TENURE,
    OUTREACH_BOOK_SIZE,
    OUTREACH_MAX_SCORE,
    PAY_ECHECK,
    TIER_AT_RISK,
    TIER_HEALTHY,
    UPSELL_RULES,
)
from churnscope.operators.ranking import global_rank


def _active():
    return F.col("churn_flag") == 0


def tier_validation(scored: DataFrame) -> DataFrame:
    """HS02: per tier - size, churned, churn rate, mean score, mean MRR."""
    return (
        scored.groupBy("health_tier")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("total_customers"),
            F.sum("churn_flag").cast("bigint").alias("churned"),
            pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
            round_to(mean("health_score"), 1).alias("avg_health_score"),
            round_to(money_mean("monthly_charges"), 2).alias("avg_mrr"),
        )
        .orderBy(F.col("avg_health_score").desc_nulls_last())
    )


def tier_validation_active_mrr(feat: DataFrame) -> DataFrame:
    """HS03: per tier of the feature frame - churn rate, size, churned and the
    active MRR, in one aggregation (no second grouping and alignment)."""
    return feat.where(F.col("health_tier").isNotNull()).groupBy("health_tier").agg(
        ratio(F.sum("churn_flag"), F.count(F.lit(1))).alias("churn_rate"),
        F.count(F.lit(1)).cast("bigint").alias("customers"),
        F.sum("churn_flag").cast("bigint").alias("churned"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
        round_money(money_sum(F.when(_active(), F.col("monthly_charges"))), 0).alias("active_mrr"),
    )


def tier_summary(scored: DataFrame) -> DataFrame:
    """HS04: executive tier view."""
    return (
        scored.groupBy("health_tier")
        .agg(
            count_if(_active()).alias("active_customers"),
            count_if(F.col("churn_flag") == 1).alias("churned_customers"),
            round_money(money_sum(F.when(_active(), F.col("monthly_charges"))), 0).alias("active_mrr"),
            pct(F.sum("churn_flag"), F.count(F.lit(1)), 1).alias("churn_rate_pct"),
            round_to(mean("health_score"), 0).alias("avg_health_score"),
        )
        .orderBy(F.col("avg_health_score").desc_nulls_last())
    )


def recommended_action():
    return first_match(ACTION_RULES)


def priority_list(scored: DataFrame, n: int = 100) -> DataFrame:
    """HS05: active At Risk accounts with a suggested action, top ``n`` by charge."""
    return (
        scored.where(_active() & (F.col("health_tier") == TIER_AT_RISK))
        .select(
            "customer_id",
            "health_score",
            "health_tier",
            "monthly_charges",
            "tenure",
            "contract",
            "is_autopay",
            "has_tech_support",
            "num_services",
            recommended_action().alias("recommended_action"),
        )
        .orderBy(F.col("monthly_charges").desc(), "customer_id")
        .limit(n)
        .withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
    )


def upsell_label():
    return first_match(UPSELL_RULES)


def expansion_list(scored: DataFrame, n: int = 50) -> DataFrame:
    """HS06: active Healthy accounts with at most 2 services and tenure above
    24 months, with an upsell suggestion, top ``n`` by charge."""
    cond = (
        _active()
        & (F.col("health_tier") == TIER_HEALTHY)
        & (F.col("num_services") <= 2)
        & (F.col("tenure") > 24)
    )
    return (
        scored.where(cond)
        .select(
            "customer_id",
            "health_score",
            "monthly_charges",
            "tenure",
            "contract",
            "num_services",
            upsell_label().alias("upsell_opportunity"),
        )
        .orderBy(F.col("monthly_charges").desc(), "customer_id")
        .limit(n)
        .withColumn("monthly_charges", F.col("monthly_charges").cast("double"))
    )


def csm_export(
    scored: DataFrame,
    max_score: int = OUTREACH_MAX_SCORE,
    book_size: int = OUTREACH_BOOK_SIZE,
    num_partitions: int | None = None,
) -> DataFrame:
    """HS07: every active account scoring below ``max_score``, ranked by MRR
    (id breaks ties) and cut into books of at most ``book_size`` accounts."""
    due = scored.where(_active() & (F.col("health_score") < max_score)).select(
        "customer_id", "health_score", "health_tier", "monthly_charges", "contract", "tenure"
    )
    ranked = global_rank(
        due, [F.col("monthly_charges").desc(), "customer_id"], "priority_rank", num_partitions
    )
    return ranked.select(
        "customer_id",
        "health_score",
        "health_tier",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        "contract",
        "tenure",
        "priority_rank",
        (F.floor((F.col("priority_rank") - 1) / book_size) + 1).cast("bigint").alias("csm_book"),
    )


def contract_migration_targets(acct: DataFrame) -> DataFrame:
    """HS08: active month-to-month accounts with at least 3 months of tenure;
    priority above the charge threshold; prices at each discount (exact)."""
    cond = (
        _active()
        & (F.col("contract") == CONTRACT_M2M)
        & (F.col("tenure") >= MIGRATION_MIN_TENURE)
    )
    cols = [
        "customer_id",
        "tenure",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        (F.col("monthly_charges") > MIGRATION_PRIORITY_CHARGE).alias("is_priority"),
    ]
    for d in MIGRATION_DISCOUNTS:
        keep = Decimal("1") - Decimal(str(d))
        price = (F.col("monthly_charges") * F.lit(keep)).cast("double")
        cols.append(round_to(price, 2).alias(f"price_{int(round(d * 100))}pct_off"))
    return acct.where(cond).select(*cols)


def autopay_targets(acct: DataFrame) -> DataFrame:
    """HS09: active accounts paying by electronic check."""
    return acct.where(_active() & (F.col("payment_method") == PAY_ECHECK)).select(
        "customer_id",
        "tenure",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        "contract",
        "paperless_billing",
    )


def onboarding_targets(acct: DataFrame) -> DataFrame:
    """HS10: active accounts in their first months with few services."""
    cond = (
        _active()
        & (F.col("tenure") <= ONBOARDING_MAX_TENURE)
        & (F.col("num_services") < ONBOARDING_MAX_SERVICES)
    )
    return acct.where(cond).select(
        "customer_id",
        "tenure",
        "num_services",
        F.col("monthly_charges").cast("double").alias("monthly_charges"),
        "contract",
    )
