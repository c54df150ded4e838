"""Revenue operators (RV01-RV10): MRR, ARR, revenue churn, LTV, risk tiers,
intervention value, Pareto concentration, scenarios and program ROI.

Money is summed exactly (decimal cents) and multiplied by exact decimal
rates before the one final rounding, so no float summation order can move
a cent.  Windows (share of total, cumulative share) run only over the few
aggregated rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.numeric import (
    count_if,
    mean,
    money,
    money_mean,
    pct,
    ratio,
    round_money,
    round_to,
)
from churnscope.functions.rules import points
from churnscope.functions.schemas import (
    CONTRACT_M2M,
    INTERNET_FIBER,
    PARETO_LABELS,
    PAY_ECHECK,
    PROGRAM_TOTAL,
    PROGRAMS,
    RISK_POINTS,
    RISK_TIER_LOW,
    RISK_TIERS,
)
from churnscope.operators.selection import ntile_columns


def active() -> Column:
    return F.col("churn_flag") == 0


def churned() -> Column:
    return F.col("churn_flag") == 1


def exact_sum(c: Column | str, where: Column | None = None) -> Column:
    """Exact decimal sum of a money column, optionally filtered (NULL if no row)."""
    v = money(c)
    return F.sum(F.when(where, v) if where is not None else v)


def money_round(dec_sum: Column, digits: int = 0, factor: Decimal | int | None = None) -> Column:
    """Round an exact decimal money expression (times an exact factor)."""
    return round_money(dec_sum if factor is None else dec_sum * F.lit(factor), digits)


def revenue_overview(acct: DataFrame) -> DataFrame:
    """RV01 + RV09: active/lost customers, MRR, ARR, revenue churn, LTV proxy,
    average tenure overall and of churned accounts."""
    active_mrr = exact_sum("monthly_charges", active())
    lost_mrr = exact_sum("monthly_charges", churned())
    return acct.agg(
        count_if(active()).alias("active_customers"),
        money_round(active_mrr).alias("current_mrr"),
        money_round(active_mrr, factor=12).alias("arr_run_rate"),
        count_if(churned()).alias("churned_customers"),
        money_round(lost_mrr).alias("mrr_lost"),
        money_round(lost_mrr, factor=12).alias("arr_lost_annualized"),
        pct(lost_mrr, exact_sum("monthly_charges"), 2).alias("revenue_churn_pct"),
        round_to(money_mean("monthly_charges") * mean("tenure"), 0).alias("avg_ltv_estimate"),
        round_to(mean("tenure"), 1).alias("avg_tenure_all"),
        round_to(mean(F.when(churned(), F.col("tenure"))), 1).alias("avg_tenure_churned"),
    )


def mrr_breakdown(acct: DataFrame) -> DataFrame:
    """RV02: MRR by contract x churn status with the share of total MRR."""
    agg = acct.groupBy("contract", "churn_flag").agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"),
        exact_sum("monthly_charges").alias("_mrr"),
        round_to(money_mean("monthly_charges"), 2).alias("avg_mrr_per_customer"),
    )
    total = F.sum("_mrr").over(Window.partitionBy())
    return agg.select(
        "contract",
        "churn_flag",
        "customers",
        money_round(F.col("_mrr")).alias("mrr"),
        "avg_mrr_per_customer",
        pct(F.col("_mrr"), total, 1).alias("pct_of_total_mrr"),
    ).orderBy("contract", "churn_flag")


def addon_risk_score() -> Column:
    """0-7 risk points of an account (typed accounts table)."""
    return points(RISK_POINTS)


def risk_tier_label(score: Column) -> Column:
    """>= 5 Critical, >= 3 High, exactly 2 Medium, else Low (first match)."""
    (crit_floor, crit), (high_floor, high), (medium_score, medium) = RISK_TIERS
    return (
        F.when(score >= crit_floor, crit)
        .when(score >= high_floor, high)
        .when(score == medium_score, medium)
        .otherwise(RISK_TIER_LOW)
    )


def risk_tiers(acct: DataFrame) -> DataFrame:
    """RV03: active accounts by add-on risk tier with MRR/ARR at risk."""
    scored = acct.where(active()).withColumn("risk_tier", risk_tier_label(addon_risk_score()))
    mrr_sum = exact_sum("monthly_charges")
    return (
        scored.groupBy("risk_tier")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("customer_count"),
            money_round(mrr_sum).alias("mrr_at_risk"),
            money_round(mrr_sum, factor=12).alias("arr_at_risk"),
            round_to(money_mean("monthly_charges"), 2).alias("avg_monthly_charge"),
        )
        .orderBy(F.col("arr_at_risk").desc(), "risk_tier")
    )


def critical_filter() -> Column:
    return (
        active()
        & (F.col("contract") == CONTRACT_M2M)
        & (F.col("internet_service") == INTERNET_FIBER)
        & (F.col("payment_method") == PAY_ECHECK)
        & (F.col("tenure") < 12)
    )


def intervention(acct: DataFrame, rates: list[float]) -> DataFrame:
    """RV04: critical active accounts, their MRR, and ARR saved per rate."""
    crit = acct.where(critical_filter())
    mrr_sum = exact_sum("monthly_charges")
    cols = [
        F.count(F.lit(1)).cast("bigint").alias("critical_customers"),
        money_round(mrr_sum).alias("monthly_mrr_at_risk"),
    ]
    for r in rates:
        dec = Decimal(str(r))
        cols.append(
            money_round(mrr_sum * F.lit(dec), factor=12).alias(f"arr_saved_at_{int(round(r * 100))}pct_retention")
        )
    return crit.agg(*cols)


def ltv_by_contract(acct: DataFrame) -> DataFrame:
    """RV05: LTV proxy (mean charge x mean tenure) and actual totals by contract."""
    return (
        acct.groupBy("contract")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("customers"),
            round_to(mean("tenure"), 1).alias("avg_tenure_months"),
            round_to(money_mean("monthly_charges"), 2).alias("avg_monthly_charges"),
            round_to(money_mean("monthly_charges") * mean("tenure"), 0).alias("avg_ltv_proxy"),
            round_to(money_mean("total_charges"), 0).alias("avg_actual_total_charges"),
        )
        .orderBy(F.col("avg_ltv_proxy").desc(), "contract")
    )


def revenue_pareto(acct: DataFrame) -> DataFrame:
    """RV06: quintiles of active accounts by charge (1 = highest), their MRR
    and share; shares use the MRR already rounded to whole units."""
    actives = acct.where(active()).select("customer_id", "monthly_charges")
    # highest first, NULL charges last
    falling = F.coalesce(-F.col("monthly_charges").cast("double"), F.lit(float("inf")))
    q = actives.withColumns(ntile_columns(actives, {"revenue_quintile": falling}, "customer_id", 5))
    summary = q.groupBy("revenue_quintile").agg(
        F.count(F.lit(1)).cast("bigint").alias("customers"),
        money_round(exact_sum("monthly_charges")).alias("mrr"),
        round_to(money_mean("monthly_charges"), 2).alias("avg_mrr"),
    )
    label = None
    for i, text in enumerate(PARETO_LABELS):
        cond = F.col("revenue_quintile") == i + 1
        label = F.when(cond, text) if label is None else label.when(cond, text)
    total = F.sum("mrr").over(Window.partitionBy())
    running = F.sum("mrr").over(Window.orderBy("revenue_quintile"))
    return summary.select(
        "revenue_quintile",
        label.alias("segment_label"),
        "customers",
        "mrr",
        "avg_mrr",
        pct(F.col("mrr"), total, 1).alias("pct_of_total_mrr"),
        pct(running, total, 1).alias("cumulative_mrr_pct"),
    ).orderBy("revenue_quintile")


def mrr_at_risk(feat: DataFrame, tier_col: str = "health_tier", tier: str = "At Risk") -> DataFrame:
    """RV07: active accounts in the At Risk tier: count and MRR."""
    at_risk = active() & (F.col(tier_col) == tier)
    return feat.agg(
        count_if(at_risk).alias("at_risk_active_customers"),
        money_round(exact_sum("monthly_charges", at_risk)).alias("mrr_at_risk"),
    )


def retention_scenarios(feat: DataFrame, rates: list[float], tier: str = "At Risk") -> DataFrame:
    """RV08: ARR saved if a share of the at-risk MRR is retained, per rate.
    One aggregate row, fanned out over the fixed rate list (no join)."""
    at_risk = active() & (F.col("health_tier") == tier)
    one = feat.agg(exact_sum("monthly_charges", at_risk).alias("_mrr"))
    rate_rows = F.array(
        *[
            F.struct(F.lit(r).alias("retention_rate"), F.lit(Decimal(str(r))).alias("_dec"))
            for r in rates
        ]
    )
    return one.select(F.col("_mrr"), F.explode(rate_rows).alias("r")).select(
        F.col("r.retention_rate").alias("retention_rate"),
        money_round(F.col("_mrr") * F.col("r._dec"), factor=12).alias("arr_saved"),
    )


def program_targets(feat: DataFrame, outreach_max_score: float) -> DataFrame:
    """Sizes of the four program target segments, in one pass."""
    return feat.agg(
        count_if(F.col("contract") == CONTRACT_M2M).alias("t0"),
        count_if(active() & (F.col("payment_method") == PAY_ECHECK)).alias("t1"),
        count_if(active() & (F.col("is_new_customer") == 1)).alias("t2"),
        count_if(active() & (F.col("health_score") < outreach_max_score)).alias("t3"),
    )


def portfolio_roi(feat: DataFrame, outreach_max_score: float = 40) -> DataFrame:
    """RV10: program cost and ARR assumptions beside the target sizes counted
    from the data, ROI per program and for the whole portfolio."""
    targets = program_targets(feat, outreach_max_score)
    rows = []
    for i, (name, target, cost, low, high) in enumerate(PROGRAMS):
        rows.append(
            F.struct(
                F.lit(name).alias("program"),
                F.lit(target).alias("target"),
                F.col(f"t{i}").alias("target_accounts"),
                F.lit(cost).alias("cost_usd"),
                F.lit(low).alias("arr_low_usd"),
                F.lit(high).alias("arr_high_usd"),
            )
        )
    cost = sum(p[2] for p in PROGRAMS)
    low = sum(p[3] for p in PROGRAMS)
    high = sum(p[4] for p in PROGRAMS)
    rows.append(
        F.struct(
            F.lit(PROGRAM_TOTAL).alias("program"),
            F.lit(None).cast("string").alias("target"),
            # Sum over programs; one account can be in several targets.
            (F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")).alias("target_accounts"),
            F.lit(cost).alias("cost_usd"),
            F.lit(low).alias("arr_low_usd"),
            F.lit(high).alias("arr_high_usd"),
        )
    )
    out = targets.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumns(
        {
            "roi_low": round_to(ratio("arr_low_usd", "cost_usd"), 2),
            "roi_high": round_to(ratio("arr_high_usd", "cost_usd"), 2),
        }
    )
