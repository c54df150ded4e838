"""Segment aggregations (SG01-SG14).

All are hash aggregations with partial (map-side) aggregation: each task
reduces its rows to one row per group before the shuffle, so the shuffle
size is (tasks x groups), independent of how rows spread over groups; a
group holding a third of all rows costs no more than any other.  Ordering
applies to the few aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import mean, money_mean, pct, ratio, round_to


def n_rows() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def churn_aggs(churn_col: str = "churn_flag") -> list[Column]:
    churned = F.sum(F.col(churn_col))
    return [
        n_rows().alias("total_customers"),
        churned.cast("bigint").alias("churned"),
        pct(churned, F.count(F.lit(1)), 1).alias("churn_rate_pct"),
    ]


def avg_tenure(digits: int = 1, name: str = "avg_tenure_months") -> Column:
    return round_to(mean("tenure"), digits).alias(name)


def avg_charges(digits: int = 2, name: str = "avg_monthly_charges") -> Column:
    return round_to(money_mean("monthly_charges"), digits).alias(name)


def segment_churn(
    df: DataFrame,
    keys: list[str | Column],
    extra: list[Column] | None = None,
    drop_null_keys: bool = False,
    churn_col: str = "churn_flag",
) -> DataFrame:
    """Rows per group, churned, churn rate (1 dp), plus ``extra`` aggregates.

    SQL keeps a NULL group; ``drop_null_keys=True`` drops it (pandas
    ``groupby`` default), for the notebook-derived variants.
    """
    if drop_null_keys:
        for k in keys:
            df = df.where((F.col(k) if isinstance(k, str) else k).isNotNull())
    return df.groupBy(*keys).agg(*churn_aggs(churn_col), *(extra or []))


def pivot_mean(
    df: DataFrame,
    row_key: str,
    col_key: str,
    values: list,
    value: Column,
    names: list[str] | None = None,
) -> DataFrame:
    """Wide table: one row per ``row_key``, one column per listed ``col_key``
    value holding ``value`` (an aggregate).  The value list is fixed, so
    Spark does not run a distinct job to discover columns; a missing
    combination is NULL."""
    wide = df.groupBy(row_key).pivot(col_key, values).agg(value)
    if names:
        wide = wide.withColumnsRenamed({str(v): n for v, n in zip(values, names)})
    return wide


def top_segments(
    df: DataFrame,
    keys: list[str],
    min_size: int,
    n: int,
) -> DataFrame:
    """Groups of at least ``min_size`` rows, the ``n`` with the highest churn
    rate (ties by keys).  A top-k (TakeOrderedAndProject) on the aggregate."""
    for k in keys:  # pandas groupby drops NULL keys
        df = df.where(F.col(k).isNotNull())
    agg = (
        df.groupBy(*keys)
        .agg(
            n_rows().alias("customers"),
            ratio(F.sum("churn_flag"), F.count(F.lit(1))).alias("_rate"),
        )
        .where(F.col("customers") >= min_size)
    )
    top = agg.orderBy(F.col("_rate").desc(), *keys).limit(n)
    return top.select(*keys, round_to(F.col("_rate") * 100.0, 1).alias("churn_rate_pct"), "customers")


def conditional_rates(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """One row: for each named condition, rows and churned rows, in one pass."""
    aggs = []
    for name, cond in conds.items():
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"{name}_n"))
        aggs.append(
            F.sum(F.when(cond, F.col("churn_flag")).otherwise(0)).cast("bigint").alias(f"{name}_churned")
        )
    return df.agg(*aggs)

