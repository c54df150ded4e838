"""Raw subscription accounts derived from the order tables.

The analysed project works on one snapshot of subscription accounts.  The
test data has none, so one order is one account (rules in FIXTURES.md §B).
The result has exactly the 21-column raw layout (``RAW_SCHEMA``), so every
downstream operator is oblivious to where the accounts came from: a CSV
export, a table, JDBC or this derivation.

Plan shape (what Catalyst is asked to do):

1. ``lineitem`` (3 columns) joins ``part`` (2 columns; the part type is
   reduced to one small integer code before the join) and is aggregated per
   order with partial (map-side) aggregation, so the shuffle carries one
   row per order and map task, never the line items themselves.  AQE picks
   broadcast for ``part`` only when its measured size is under the
   broadcast threshold, otherwise a sort-merge join whose skewed partitions
   it splits.
2. ``orders`` joins ``customer`` on the customer key and the per-order
   aggregate on the order key, both left: an order without a customer row
   stays an account (``orphan_orders`` counts them).  The aggregate is already
   hash-partitioned by order key, so that join reuses its partitioning.
3. All remaining work is one projection of column expressions.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.functions.schemas import (
    AUTOPAY_METHODS,
    CONTRACT_M2M,
    CONTRACT_ONE,
    CONTRACT_TWO,
    INTERNET_DSL,
    INTERNET_FIBER,
    INTERNET_NONE,
    PAY_BANK,
    PAY_CARD,
    PAY_ECHECK,
    PAY_MAILED,
    RAW_SCHEMA,
)

# --------------------------------------------------------------------------
# FIXED VALUES of the account mapping (FIXTURES.md §B)
# --------------------------------------------------------------------------
# Part-type families giving the six add-on services, in service order:
# online security, online backup, device protection, tech support,
# streaming TV, streaming movies.
PART_FAMILIES = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
# Month index of August 2001 (12 * year + month); tenure counts back from it,
# unbounded: months past the last band have no band, later ones are negative.
TENURE_ORIGIN_MONTH = 24020
# Digits of the largest order key (bigint), so that ids sort like their keys.
ID_DIGITS = 19
FIBER_SEGMENTS = ["BUILDING", "AUTOMOBILE"]
NO_INTERNET_SEGMENT = "FURNITURE"
STATUS_TO_CONTRACT = {"P": CONTRACT_M2M, "F": CONTRACT_ONE, "O": CONTRACT_TWO}
PRIORITY_TO_PAYMENT = {
    "1-URGENT": PAY_ECHECK,
    "2-HIGH": PAY_MAILED,
    "3-MEDIUM": PAY_BANK,
    "4-NOT SPECIFIED": PAY_ECHECK,
    "5-LOW": PAY_CARD,
}
BASE_CHARGE_CENTS = 1825
CHARGE_STEP_CENTS = 5000
# --------------------------------------------------------------------------

assert set(AUTOPAY_METHODS) == {PAY_BANK, PAY_CARD}

SERVICE_RAW_COLUMNS = [
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def _map_values(c: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(c == key, value) if expr is None else expr.when(c == key, value))
    return expr


def order_line_profile(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per order: number of lines, returned lines, and one flag per part family."""
    # The family is the first word of the part type ("STANDARD ..." or "STANDARD").
    first_word = F.substring_index(F.col("p_type"), " ", 1)
    family_code = None
    for i, family in enumerate(PART_FAMILIES):
        cond = first_word == family
        family_code = F.when(cond, i) if family_code is None else family_code.when(cond, i)
    parts = part.select(F.col("p_partkey"), family_code.cast("tinyint").alias("family"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    aggs = [
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
    ]
    aggs += [
        F.max(F.when(F.col("family") == i, 1).otherwise(0)).alias(f"s{i + 1}")
        for i in range(len(PART_FAMILIES))
    ]
    return joined.groupBy(F.col("l_orderkey")).agg(*aggs)


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21-column raw accounts (``RAW_SCHEMA``) from the order tables of ``sf_dir``."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    profile = order_line_profile(
        read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    )
    base = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        profile, orders.o_orderkey == profile.l_orderkey, "left"
    )
    return accounts_from_orders(base)


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: orders, those without a customer key, and those whose customer
    key has no customer row."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey")
    known = read_table(spark, sf_dir, "customer").select(F.col("c_custkey")).where("c_custkey is not null").distinct()
    per_key = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = per_key.join(known, per_key.o_custkey == known.c_custkey, "left")
    no_key, no_row = F.col("o_custkey").isNull(), F.col("o_custkey").isNotNull() & F.col("c_custkey").isNull()
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce(F.sum(F.when(no_key, F.col("n"))), F.lit(0)).cast("bigint").alias("without_customer_key"),
        F.coalesce(F.sum(F.when(no_row, F.col("n"))), F.lit(0)).cast("bigint").alias("customer_row_missing"),
    )


def accounts_from_orders(base: DataFrame) -> DataFrame:
    okey = F.col("o_orderkey")
    ckey = F.col("o_custkey")
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0))
    n_ret = F.coalesce(F.col("n_ret"), F.lit(0))

    month_index = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    tenure = (F.lit(TENURE_ORIGIN_MONTH) - month_index).cast("int")

    seg = F.col("c_mktsegment")
    internet = (
        F.when(seg.isin(FIBER_SEGMENTS), INTERNET_FIBER)
        .when(seg == NO_INTERNET_SEGMENT, INTERNET_NONE)
        .otherwise(INTERNET_DSL)
    )
    phone = F.when(ckey % 10 == 0, "No").otherwise("Yes")
    contract = _map_values(F.col("o_orderstatus"), STATUS_TO_CONTRACT)
    contract = F.when(okey % 50 == 0, F.concat(F.lit(" "), contract, F.lit(" "))).otherwise(contract)

    # Integer cents throughout; the step division is exact.
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    mcc = F.lit(BASE_CHARGE_CENTS) + (
        (cents - cents % CHARGE_STEP_CENTS) / CHARGE_STEP_CENTS
    ).cast("bigint")
    monthly = (mcc.cast("decimal(10,0)") * F.lit(Decimal("0.01"))).cast("decimal(8,2)")
    t_units = mcc * tenure * (F.lit(100) - okey % 7)
    total_text = F.concat(
        ((t_units - t_units % 10000) / 10000).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(((t_units % 10000 - t_units % 100) / 100).cast("bigint").cast("string"), 2, "0"),
    )
    total = F.when(tenure <= 0, F.lit(" ")).otherwise(total_text)

    status = F.col("o_orderstatus")
    churn = (
        (n_lines > 0)
        & (
            ((status == "P") & (n_ret * 2 >= n_lines))
            | ((status == "F") & (n_ret * 3 >= n_lines * 2))
            | ((status == "O") & (n_ret == n_lines))
        )
    )

    services = []
    for i, name in enumerate(SERVICE_RAW_COLUMNS):
        flag = F.coalesce(F.col(f"s{i + 1}"), F.lit(0))
        services.append(
            F.when(internet == INTERNET_NONE, F.lit("No internet service"))
            .otherwise(_yes_no(flag == 1))
            .alias(name)
        )

    cols = [
        F.concat(F.lit("A"), F.lpad(okey.cast("string"), ID_DIGITS, "0")).alias("customerID"),
        F.when(ckey % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("SeniorCitizen"),
        _yes_no(F.col("c_nationkey") % 2 == 0).alias("Partner"),
        _yes_no(ckey % 3 == 0).alias("Dependents"),
        tenure.alias("tenure"),
        phone.alias("PhoneService"),
        F.when(phone == "No", "No phone service")
        .otherwise(_yes_no(okey % 2 == 0))
        .alias("MultipleLines"),
        internet.alias("InternetService"),
        *services,
        contract.alias("Contract"),
        _yes_no(okey % 5 < 3).alias("PaperlessBilling"),
        _map_values(F.col("o_orderpriority"), PRIORITY_TO_PAYMENT).alias("PaymentMethod"),
        monthly.alias("MonthlyCharges"),
        total.alias("TotalCharges"),
        _yes_no(churn).alias("Churn"),
    ]
    out = base.select(*cols)
    # Cast to the declared raw schema (nullability and exact types).
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


# --------------------------------------------------------------------------
# The same derivation as SQL (DuckDB dialect), for the oracle queries.
# It is written independently of the DataFrame code above.
# --------------------------------------------------------------------------

def _family_case() -> str:
    parts = " ".join(
        f"WHEN split_part(p_type, ' ', 1) = '{fam}' THEN {i}" for i, fam in enumerate(PART_FAMILIES)
    )
    return f"CASE {parts} END"


def raw_accounts_sql() -> str:
    """SQL CTE body (no WITH) named ``raw_accounts`` plus its helpers."""
    flags = ",\n        ".join(
        f"MAX(CASE WHEN fam = {i} THEN 1 ELSE 0 END) AS s{i + 1}" for i in range(6)
    )
    service_cols = ",\n        ".join(
        f"CASE WHEN internet = 'No' THEN 'No internet service' "
        f"WHEN COALESCE(s{i + 1}, 0) = 1 THEN 'Yes' ELSE 'No' END AS {name}"
        for i, name in enumerate(SERVICE_RAW_COLUMNS)
    )
    return f"""
acct_lines AS (
    SELECT l.l_orderkey,
        COUNT(*) AS n_lines,
        SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
        {flags}
    FROM lineitem l
    LEFT JOIN (SELECT p_partkey, {_family_case()} AS fam FROM part) p
        ON l.l_partkey = p.p_partkey
    GROUP BY l.l_orderkey
),
acct_base AS (
    SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority,
        o.o_custkey, c.c_nationkey, c.c_acctbal,
        CASE WHEN c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'Fiber optic'
             WHEN c.c_mktsegment = 'FURNITURE' THEN 'No' ELSE 'DSL' END AS internet,
        CAST({TENURE_ORIGIN_MONTH} - (12 * year(o.o_orderdate) + month(o.o_orderdate)) AS INTEGER) AS ten,
        {BASE_CHARGE_CENTS} + (CAST(ROUND(o.o_totalprice * 100) AS BIGINT)
            - CAST(ROUND(o.o_totalprice * 100) AS BIGINT) % {CHARGE_STEP_CENTS}) // {CHARGE_STEP_CENTS} AS mcc,
        COALESCE(a.n_lines, 0) AS n_lines, COALESCE(a.n_ret, 0) AS n_ret,
        a.s1, a.s2, a.s3, a.s4, a.s5, a.s6
    FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN acct_lines a ON o.o_orderkey = a.l_orderkey
),
acct_units AS (
    SELECT *, CAST(mcc * ten * (100 - o_orderkey % 7) AS BIGINT) AS t_units,
        CASE o_orderstatus WHEN 'P' THEN 'Month-to-month' WHEN 'F' THEN 'One year'
             WHEN 'O' THEN 'Two year' END AS contract0
    FROM acct_base
),
raw_accounts AS (
    SELECT
        'A' || lpad(CAST(o_orderkey AS VARCHAR), {ID_DIGITS}, '0') AS customerID,
        CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS SeniorCitizen,
        CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
        CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
        ten AS tenure,
        CASE WHEN o_custkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
        CASE WHEN o_custkey % 10 = 0 THEN 'No phone service'
             WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS MultipleLines,
        internet AS InternetService,
        {service_cols},
        CASE WHEN o_orderkey % 50 = 0 THEN ' ' || contract0 || ' ' ELSE contract0 END AS Contract,
        CASE WHEN o_orderkey % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Electronic check'
             WHEN '4-NOT SPECIFIED' THEN 'Electronic check'
             WHEN '2-HIGH' THEN 'Mailed check'
             WHEN '3-MEDIUM' THEN 'Bank transfer (automatic)'
             WHEN '5-LOW' THEN 'Credit card (automatic)' END AS PaymentMethod,
        CAST(CAST(mcc AS DECIMAL(10,0)) * 0.01 AS DECIMAL(8,2)) AS MonthlyCharges,
        CASE WHEN ten <= 0 THEN ' '
             ELSE CAST((t_units - t_units % 10000) // 10000 AS VARCHAR) || '.'
                  || lpad(CAST((t_units % 10000 - t_units % 100) // 100 AS VARCHAR), 2, '0')
        END AS TotalCharges,
        CASE WHEN n_lines > 0 AND (
                 (o_orderstatus = 'P' AND n_ret * 2 >= n_lines)
              OR (o_orderstatus = 'F' AND n_ret * 3 >= 2 * n_lines)
              OR (o_orderstatus = 'O' AND n_ret = n_lines))
             THEN 'Yes' ELSE 'No' END AS Churn
    FROM acct_units
)"""
