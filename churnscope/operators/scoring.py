"""The scored accounts table (HS01, IO09): quintiles, 0-dp health score, tier.

Quintiles are global NTILEs over three different orders, found by value cells
(``selection.ntile_columns``): no sort of the rows.  The points are computed once as a column and reused by the score
and the tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import round_to
from churnscope.functions.schemas import (
    AUTOPAY_POINTS,
    MAX_RAW_POINTS,
    POINTS_PER_SERVICE,
    TECH_SUPPORT_POINTS,
    TIER_AT_RISK,
    TIER_HEALTHY,
    TIER_NEEDS,
)
from churnscope.operators.features import contract_points, tenure_points
from churnscope.operators.selection import ntile_columns

SCORE_COLUMNS = [
    "customer_id",
    "monthly_charges",
    "tenure",
    "num_services",
    "is_autopay",
    "has_tech_support",
    "contract",
    "churn_flag",
]


def sql_points(df: DataFrame):
    return (
        tenure_points(F.col("tenure"))
        + contract_points(F.col("contract"))
        + F.col("num_services") * POINTS_PER_SERVICE
        + F.when(F.col("is_autopay"), AUTOPAY_POINTS).otherwise(0)
        + F.when(F.col("has_tech_support"), TECH_SUPPORT_POINTS).otherwise(0)
    )


def add_health_score_sql(acct: DataFrame) -> DataFrame:
    """Integer score = round(points * 100 / 105) capped at 100; tier by
    >= 70 Healthy, >= 40 Needs Attention, else At Risk.  Unknown points
    (tenure outside 0..72, unknown contract) give NULL score and tier."""
    points = sql_points(acct)
    # NULL points stay NULL through the arithmetic and the rounding.
    scaled = round_to(points.cast("double") * 100.0 / MAX_RAW_POINTS, 0)
    with_pts = acct.withColumn("_scaled", scaled)
    s = F.col("_scaled")
    return with_pts.withColumns(
        {
            # A CASE cap keeps NULL (least() would skip it and give 100).
            "health_score": F.when(s > 100.0, F.lit(100.0)).otherwise(s).cast("int"),
            "health_tier": F.when(s >= 70, TIER_HEALTHY)
            .when(s >= 40, TIER_NEEDS)
            .when(s.isNotNull(), TIER_AT_RISK),
        }
    ).drop("_scaled")


def score_accounts(acct: DataFrame) -> DataFrame:
    """Score columns plus the 0-dp score and tier, without the quintiles.

    Queries that only read the score and tier use this: it is one
    projection, so they do not pay for three global sorts."""
    return add_health_score_sql(acct.select(*SCORE_COLUMNS))


def build_scores(acct: DataFrame) -> DataFrame:
    """IO09: the scored table (13 columns) from typed accounts."""
    base = acct.select(*SCORE_COLUMNS)
    orders = {
        "tenure_score_raw": F.col("tenure"),
        "charge_score_raw": F.col("monthly_charges"),
        "service_score_raw": F.col("num_services"),
    }
    ranked = base.withColumns(ntile_columns(base, orders, "customer_id", 5))
    scored = add_health_score_sql(ranked)
    return scored.select(
        *SCORE_COLUMNS,
        "tenure_score_raw",
        "charge_score_raw",
        "service_score_raw",
        "health_score",
        "health_tier",
    )
