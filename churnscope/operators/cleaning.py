"""Cleaning and typing of raw accounts (CL01-CL12, IO08).

Two cleaned forms exist, as in the analysed project:

* ``clean``: the analysis frame (snake_case names, trimmed strings, numeric
  total charges, senior flag as Yes/No, ``churn_flag`` 0/1).  Charges are
  doubles here.
* ``build_accounts``: the typed accounts table (booleans, exact decimals,
  service count, SQL tenure bands, auto-pay flag).

Both are single projections: no shuffle, no UDF; Catalyst fuses them into
the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnscope.functions.numeric import count_if, pct
from churnscope.functions.schemas import (
    AUTOPAY_METHODS,
    RAW_TO_CLEAN,
    SERVICE_COLS,
    TENURE_BANDS,
    TENURE_LABELS_SQL,
    TYPED_BOOLEANS,
)

# Whitespace stripped from both ends: space, tab, newline, vertical tab,
# form feed, carriage return (tabs too, not just spaces).  A character-set
# trim, not a regular expression: one pass over each end of the value.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def standardize_columns(raw: DataFrame) -> DataFrame:
    """CL01: rename the raw export columns to snake_case (only those present)."""
    mapping = {k: v for k, v in RAW_TO_CLEAN.items() if k in raw.columns}
    return raw.withColumnsRenamed(mapping)


def trim_strings(df: DataFrame) -> DataFrame:
    """CL02: strip every string column."""
    return df.select(
        *[
            strip_ws(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def fix_total_charges(df: DataFrame) -> DataFrame:
    """CL03: blank/NULL total -> monthly charge; other text parsed, bad text -> NULL."""
    total = F.col("total_charges")
    fixed = F.when(_blank(total), F.col("monthly_charges").cast("double")).otherwise(
        total.try_cast("double")
    )
    return df.withColumns(
        {"total_charges": fixed, "monthly_charges": F.col("monthly_charges").cast("double")}
    )


def normalize_senior(df: DataFrame) -> DataFrame:
    """CL04: 0 -> No, 1 -> Yes, anything else NULL."""
    s = F.col("senior_citizen")
    return df.withColumn("senior_citizen", F.when(s == 0, "No").when(s == 1, "Yes"))


def add_churn_flag(df: DataFrame) -> DataFrame:
    """CL06: 1 when churn = Yes, else 0 (NULL counts as 0)."""
    return df.withColumn(
        "churn_flag", F.when(F.col("churn") == "Yes", 1).otherwise(0).cast("int")
    )


def clean(raw: DataFrame) -> DataFrame:
    """CL12: the whole cleaning chain, in the analysed project's order."""
    return (
        raw.transform(standardize_columns)
        .transform(trim_strings)
        .transform(fix_total_charges)
        .transform(normalize_senior)
        .transform(add_churn_flag)
    )


def cleaning_report(raw: DataFrame) -> DataFrame:
    """CL11: metrics of the cleaning run as long rows ``(metric, value)``.

    One aggregation pass over the cleaned frame computes every metric and
    every per-column null count; the wide row is then unpivoted.  Null counts
    appear only for columns that still have NULLs (``nulls.<column>``).
    """
    trimmed = trim_strings(standardize_columns(raw))
    n_renamed = len([c for c in RAW_TO_CLEAN if c in raw.columns])
    # Keep the trimmed total text beside the cleaned value for the blank test.
    staged = trimmed.withColumn("total_charges_raw", F.col("total_charges"))
    both = staged.transform(fix_total_charges).transform(normalize_senior).transform(add_churn_flag)
    blank_total = _blank(F.col("total_charges_raw"))
    cols = [c for c in both.columns if c != "total_charges_raw"]
    aggs = [
        F.lit(n_renamed).cast("double").alias("columns_renamed"),
        count_if(blank_total).cast("double").alias("total_charges_imputed"),
        count_if(F.col("total_charges").isNull()).cast("double").alias("total_charges_nulls_after_coerce"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 2).alias("churn_rate_pct"),
        F.coalesce(F.sum("churn_flag"), F.lit(0)).cast("double").alias("churned_count"),
        count_if(F.col("churn_flag") == 0).cast("double").alias("retained_count"),
        F.count(F.lit(1)).cast("double").alias("total_rows"),
        F.lit(len(cols)).cast("double").alias("total_cols"),
    ]
    aggs += [count_if(F.col(c).isNull()).cast("double").alias(f"nulls.{c}") for c in cols]
    wide = both.agg(*aggs)
    names = [a for a in wide.columns]
    long = wide.unpivot([], [F.col(f"`{n}`") for n in names], "metric", "value")
    return long.where(~F.col("metric").startswith("nulls.") | (F.col("value") > 0))


def _sql_band(c: Column, labels: list[str]) -> Column:
    expr = None
    for (lo, hi), label in zip(TENURE_BANDS, labels):
        cond = c.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def num_services_expr(yes: callable) -> Column:
    return reduce(lambda a, b: a + b, [F.when(yes(c), 1).otherwise(0) for c in SERVICE_COLS]).cast("int")


def build_accounts(raw: DataFrame) -> DataFrame:
    """IO08: the typed accounts table (24 columns) from raw accounts.

    Strings are stripped first (the raw export may pad values), so a padded
    blank total is still recognised as blank.
    """
    df = trim_strings(standardize_columns(raw))

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c) == "Yes", F.lit(False))

    total = F.col("total_charges")
    total_typed = F.when(_blank(total), F.col("monthly_charges").cast("decimal(10,2)")).otherwise(
        total.try_cast("decimal(10,2)")
    )
    return df.select(
        "customer_id",
        "gender",
        F.col("senior_citizen").cast("boolean").alias("is_senior"),
        yes("partner").alias(TYPED_BOOLEANS["partner"]),
        yes("dependents").alias(TYPED_BOOLEANS["dependents"]),
        F.col("tenure").cast("int").alias("tenure"),
        yes("phone_service").alias(TYPED_BOOLEANS["phone_service"]),
        yes("multiple_lines").alias(TYPED_BOOLEANS["multiple_lines"]),
        "internet_service",
        *[yes(c).alias(TYPED_BOOLEANS[c]) for c in SERVICE_COLS],
        "contract",
        yes("paperless_billing").alias(TYPED_BOOLEANS["paperless_billing"]),
        "payment_method",
        F.col("monthly_charges").cast("decimal(8,2)").alias("monthly_charges"),
        total_typed.alias("total_charges"),
        F.when(F.col("churn") == "Yes", 1).otherwise(0).cast("int").alias("churn_flag"),
        num_services_expr(lambda c: F.col(c) == "Yes").alias("num_services"),
        _sql_band(F.col("tenure"), TENURE_LABELS_SQL).alias("tenure_bucket"),
        F.coalesce(F.col("payment_method").isin(AUTOPAY_METHODS), F.lit(False)).alias("is_autopay"),
    )
