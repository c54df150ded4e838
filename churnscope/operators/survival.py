"""Survival analysis of tenure (CO03): product-limit curves and log-rank tests.

An account's tenure is its observed time; it ends in churn or is censored while
the account is active.  Both operators work on the histogram (group, tenure,
churned, censored), one row per month, which partial aggregation makes of the
rows; windows only run over those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.numeric import ratio, round_to
from churnscope.operators.stats import erfc

Z95 = 1.959963984540054  # two-sided 95 % point of the normal distribution


def life_table(df: DataFrame, group: str, time: str = "tenure", event: str = "churn_flag") -> DataFrame:
    """(group, time, events, censored, at_risk) per group and time at which an
    account was last seen; rows with a NULL in any of the three are left out."""
    known = df.where(F.col(group).isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull())
    hist = known.groupBy(group, time).agg(
        F.sum(event).cast("bigint").alias("events"), F.sum(1 - F.col(event)).cast("bigint").alias("censored"), F.count(F.lit(1)).alias("accounts")
    )
    later = Window.partitionBy(group).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("at_risk", F.sum("accounts").over(later)).drop("accounts")


def kaplan_meier(df: DataFrame, group: str, time: str = "tenure", event: str = "churn_flag") -> DataFrame:
    """The product-limit estimate per group and time with Greenwood's standard
    error and the 95 % interval (cut to [0, 1]), 6 places."""
    n, d = F.col("at_risk").cast("double"), F.col("events").cast("double")
    so_far = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(so_far) == 1
    log_left = F.sum(F.when(F.col("events") < F.col("at_risk"), F.ln(1 - d / n)).otherwise(0.0)).over(so_far)
    spread = F.sum(F.when(F.col("events") < F.col("at_risk"), d / (n * (n - d))).otherwise(0.0)).over(so_far)
    rows = life_table(df, group, time, event).withColumns(
        {"s": F.when(ended, 0.0).otherwise(F.exp(log_left)), "se": F.when(ended, 0.0).otherwise(F.exp(log_left) * F.sqrt(spread))}
    )
    return rows.select(
        group, time, "at_risk", "events", "censored", round_to(F.col("s"), 6).alias("survival"), round_to(F.col("se"), 6).alias("std_error"),
        round_to(F.greatest(F.col("s") - Z95 * F.col("se"), F.lit(0.0)), 6).alias("lower_95"),
        round_to(F.least(F.col("s") + Z95 * F.col("se"), F.lit(1.0)), 6).alias("upper_95"),
    )


def log_rank(df: DataFrame, group: str, time: str = "tenure", event: str = "churn_flag") -> DataFrame:
    """Log-rank test of every two groups: observed and expected events of the
    first, chi-square (one degree of freedom) and p-value, 6 places; NULL where
    no event tells the two apart."""
    table = life_table(df, group, time, event)
    times = table.agg(F.array_sort(F.collect_set(time))).scalar()
    # Every time of any group: at risk are the group's accounts seen that long.
    seen = F.when(F.col(time) >= F.col("t"), F.col("events") + F.col("censored")).otherwise(0)
    ended = F.when(F.col(time) == F.col("t"), F.col("events")).otherwise(0)
    grid = table.withColumn("t", F.explode(times)).groupBy(group, "t").agg(F.sum(seen).alias("n"), F.sum(ended).alias("events"))
    side = lambda s: grid.select(F.col(group).alias(f"group_{s}"), "t", F.col("events").cast("double").alias(f"d{s}"), F.col("n").cast("double").alias(f"n{s}"))
    both = side("a").join(side("b"), "t").where("group_a < group_b")
    n, d = F.col("na") + F.col("nb"), F.col("da") + F.col("db")
    share = ratio(F.col("na"), n)
    var = F.coalesce(ratio(d * share * (1 - share) * (n - d), n - 1), F.lit(0.0))
    sums = both.groupBy("group_a", "group_b").agg(
        F.sum("da").alias("o"), F.sum(F.coalesce(d * share, F.lit(0.0))).alias("e"), F.sum(var).alias("v")
    )
    chi = ratio((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.when(F.col("v") > 0, F.col("v")))
    p = F.when(chi.isNotNull(), F.least(erfc(F.sqrt(chi / 2.0)), F.lit(1.0)))
    return sums.select(
        "group_a", "group_b", F.col("o").cast("bigint").alias("observed_a"), round_to(F.col("e"), 6).alias("expected_a"),
        round_to(chi, 6).alias("chi_square"), round_to(p, 6).alias("p_value"),
    )
