"""Data quality and profiling (Q01-Q17).

Every check is one aggregation pass: many conditional counts in one
``agg`` (partial aggregation, a one-row result), then reshaped into long
rows on that single row.  The several-scans-glued-by-UNION form of a
check table becomes one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnscope.functions.numeric import count_if, mean, money_mean, pct, round_money, round_to
from churnscope.operators.cleaning import strip_ws


def _rows(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Reshape a one-row aggregate into long rows (one struct per row)."""
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def profile(df: DataFrame) -> DataFrame:
    """Q01: per column - position, type, NULL count, blank-string count, and
    the frame's row and column counts."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        aggs.append(count_if(F.col(f.name).isNull()).alias(f"_n{i}"))
        if isinstance(f.dataType, StringType):
            blank = strip_ws(F.col(f.name)) == ""
            aggs.append(count_if(blank).alias(f"_b{i}"))
    wide = df.agg(*aggs)
    structs = []
    for i, f in enumerate(fields):
        # A non-string value cannot be a blank string: 0, not NULL.
        blank = F.col(f"_b{i}") if isinstance(f.dataType, StringType) else F.lit(0).cast("bigint")
        structs.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(i + 1).cast("int").alias("position"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col(f"_n{i}").alias("null_count"),
                blank.alias("blank_count"),
                F.col("_rows").cast("bigint").alias("total_rows"),
                F.lit(len(fields)).cast("int").alias("total_columns"),
            )
        )
    return _rows(wide, structs)


# Columns of the completeness table, after the row count.
COMPLETENESS_COLUMNS = ["customer_id", "monthly_charges", "tenure", "churn_flag"]


def completeness(acct: DataFrame) -> DataFrame:
    """Q02: check table (check_name, result as text, note) in one pass."""
    wide = acct.agg(
        F.count(F.lit(1)).alias("total"), *[count_if(F.col(c).isNull()).alias(c) for c in COMPLETENESS_COLUMNS]
    )
    checks = [("Total rows", "total", "Expected > 0"), *[(f"Null {c}", c, "Expected 0") for c in COMPLETENESS_COLUMNS]]
    return _rows(
        wide,
        [
            F.struct(F.lit(name).alias("check_name"), F.col(c).cast("string").alias("result"), F.lit(note).alias("note"))
            for name, c, note in checks
        ],
    )


def duplicate_ids(acct: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Q03: COUNT(*) - COUNT(DISTINCT id) (every NULL id counts)."""
    return acct.agg(
        F.lit("Duplicate customer IDs").alias("check_name"),
        (F.count(F.lit(1)) - F.countDistinct(id_col)).cast("bigint").alias("duplicate_count"),
        F.lit("Expected 0").alias("note"),
    )


def value_counts(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Q04: (field, value, count) for several columns in one scan: each row
    emits one (field, value) pair per listed column, then one aggregation."""
    pairs = F.array(
        *[F.struct(F.lit(label).alias("field"), F.col(c).alias("value")) for label, c in fields.items()]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.field", "p.value")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    )


def numeric_ranges(acct: DataFrame) -> DataFrame:
    """Q05."""
    return acct.agg(
        F.min("monthly_charges").cast("double").alias("min_monthly"),
        F.max("monthly_charges").cast("double").alias("max_monthly"),
        round_to(money_mean("monthly_charges"), 2).alias("avg_monthly"),
        F.min("total_charges").cast("double").alias("min_total"),
        F.max("total_charges").cast("double").alias("max_total"),
        F.min("tenure").alias("min_tenure"),
        F.max("tenure").alias("max_tenure"),
    )


def business_rules(acct: DataFrame, service_flags: list[str]) -> DataFrame:
    """Q06-Q07: zero charge with tenure > 0; internet add-ons without internet."""
    any_addon = F.lit(False)
    for c in service_flags:
        any_addon = any_addon | F.col(c)
    return acct.agg(
        count_if((F.col("monthly_charges") == 0) & (F.col("tenure") > 0)).alias(
            "suspicious_zero_charge_customers"
        ),
        count_if((F.col("internet_service") == "No") & any_addon).alias("addons_without_internet"),
    )


def summary(acct: DataFrame) -> DataFrame:
    """Q09: customers, churned, retained, churn %, MRR, MRR lost, revenue churn %."""
    churned = F.sum("churn_flag")
    lost = F.sum(F.when(F.col("churn_flag") == 1, F.col("monthly_charges").cast("decimal(12,2)")))
    total_mrr = F.sum(F.col("monthly_charges").cast("decimal(12,2)"))
    return acct.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        churned.cast("bigint").alias("churned_customers"),
        (F.count(F.lit(1)) - churned).cast("bigint").alias("retained_customers"),
        pct(churned, F.count(F.lit(1)), 2).alias("overall_churn_pct"),
        round_money(total_mrr).alias("total_mrr"),
        round_money(lost).alias("mrr_lost_to_churn"),
        pct(lost, total_mrr, 2).alias("revenue_churn_pct"),
    )


def sanity(acct: DataFrame) -> DataFrame:
    """Q10: the load sanity row."""
    return acct.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.sum("churn_flag").cast("bigint").alias("total_churned"),
        pct(F.sum("churn_flag"), F.count(F.lit(1)), 2).alias("churn_rate_pct"),
        round_to(money_mean("monthly_charges"), 2).alias("avg_monthly_charge"),
        round_to(mean("tenure"), 1).alias("avg_tenure_months"),
    )


# Rules of the post-clean assertion table, in order.
ASSERTION_RULES = [
    "duplicate_customer_ids",
    "churn_flag_not_binary",
    "negative_tenure",
    "negative_monthly_charges",
    "monthly_charges_over_200",
    "total_below_90pct_of_monthly",
    "all_null_rows",
]


THRESHOLDS = [0, 0, 0, 0, 0, 20, 0]


def _row_rules(columns: list[str]) -> list[Column]:
    """The rules that need one row at a time, as mergeable aggregates r1 to r6,
    and the largest charge."""
    all_null = F.lit(True)
    for c in columns:
        all_null = all_null & F.col(c).isNull()
    return [
        count_if(~F.coalesce(F.col("churn_flag").isin(0, 1), F.lit(False))).alias("r1"),
        count_if(F.col("tenure") < 0).alias("r2"),
        count_if(F.col("monthly_charges") < 0).alias("r3"),
        count_if(F.col("monthly_charges") > 200).alias("r4"),
        count_if(F.col("total_charges") < F.col("monthly_charges") * 0.9).alias("r5"),
        count_if(all_null).alias("r6"),
        F.max("monthly_charges").alias("max_monthly"),
    ]


def _rule_table(wide: DataFrame) -> DataFrame:
    """(rule, violations, threshold, passed, detail) from one row of counts."""
    structs = []
    for i, (rule, limit) in enumerate(zip(ASSERTION_RULES, THRESHOLDS)):
        detail = (
            F.concat(F.lit("max="), F.col("max_monthly").cast("string"))
            if rule == "monthly_charges_over_200"
            else F.lit(None).cast("string")
        )
        structs.append(
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(f"r{i}").alias("violations"),
                F.lit(limit).cast("bigint").alias("threshold"),
                (F.col(f"r{i}") <= limit).alias("passed"),
                detail.alias("detail"),
            )
        )
    return _rows(wide, structs)


def assertions(clean_df: DataFrame) -> DataFrame:
    """Q11-Q17: the post-clean rules as a table (rule, violations, threshold,
    passed, detail).  One pass; duplicates are counted as repeated values
    (a repeated NULL id counts too)."""
    has_null_id = F.max(F.when(F.col("customer_id").isNull(), 1).otherwise(0))
    dupes = F.count(F.lit(1)) - F.countDistinct("customer_id") - F.coalesce(has_null_id, F.lit(0))
    return _rule_table(clean_df.agg(dupes.cast("bigint").alias("r0"), *_row_rules(clean_df.columns)))


def watched(df: DataFrame, metrics: Observation | str, unique_ids: bool = True) -> DataFrame:
    """``df``, whose next job also measures the rules of ``assertions``: the
    counts travel with the tasks of that job, so they cost no pass of their own.
    ``metrics`` is an ``Observation``, or a name for a streaming query.

    Repeated ids are found by numbering the rows of each id (one shuffle by id;
    a hot id's rows pass through one task, which spills).  A streaming query
    cannot number rows: there, without ``unique_ids``, the rule counts nothing."""
    again = F.lit(False)
    if unique_ids:
        again = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.lit(1))) > 1
    marked = df.withColumn("_again", again)
    return marked.observe(metrics, count_if(F.col("_again")).alias("r0"), *_row_rules(df.columns)).drop("_again")


def rules_of(spark: SparkSession, metrics: dict) -> DataFrame:
    """The rule table from the measured counts."""
    most = metrics["max_monthly"]
    counts = [F.lit(metrics[f"r{i}"]).cast("bigint").alias(f"r{i}") for i in range(len(ASSERTION_RULES))]
    return _rule_table(spark.range(1).select(*counts, F.lit(most).alias("max_monthly")))


def validate(clean_df: DataFrame) -> bool:
    """Raise ``ValueError`` listing every failed rule; return True otherwise.

    Collects the 7-row rule table only (never the data)."""
    failed = [r for r in assertions(clean_df).collect() if not r["passed"]]
    if failed:
        lines = [f"  {r['rule']}: {r['violations']} (threshold {r['threshold']})" for r in failed]
        raise ValueError("Data validation failed:\n" + "\n".join(lines))
    return True

