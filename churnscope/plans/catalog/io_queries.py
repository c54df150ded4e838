"""Named source/sink queries (IO01, IO02, IO05-IO07, IO10).

Each writes data derived from the order tables through a real source or
sink (CSV export, Parquet table with layout, SQL text over a view) and
reads it back; the oracle is the same data computed in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnscope.functions.schemas import RAW_COLUMNS
from churnscope.operators.cleaning import build_accounts
from churnscope.operators.scoring import score_accounts
from churnscope.plans.catalog.table_queries import decimals_as_double
from churnscope.plans.registry import query
from churnscope.sources import io, refresh

_RAW_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c == "MonthlyCharges" else c for c in RAW_COLUMNS)


@query("src_csv_roundtrip", f"SELECT {_RAW_SQL} FROM raw_accounts", ("IO01",))
def src_csv_roundtrip(fr):
    """Raw accounts written as a CSV export and read back with the declared
    schema; padded values and the one-space blank totals survive."""
    path = io.write_raw_csv(fr.raw, io.scratch_dir(fr.spark, "csv") + "/raw_accounts")
    return decimals_as_double(io.read_raw_csv(fr.spark, path))


@query("src_bulk_load", f"SELECT {_RAW_SQL} FROM raw_accounts", ("IO02",))
def src_bulk_load(fr):
    """A CSV export bulk-loaded into a table of the catalog, and that table (a
    new one each time: a warehouse folder may outlive its catalog)."""
    path = io.write_raw_csv(fr.raw, io.scratch_dir(fr.spark, "bulk") + "/raw_accounts")
    return decimals_as_double(io.load_raw_table(fr.spark, path, f"churnscope_raw_{uuid.uuid4().hex}"))


# SQL text valid for Spark and DuckDB; {table} is the typed accounts table.
USER_QUERY = (
    "SELECT contract, internet_service, CAST(COUNT(*) AS BIGINT) AS customers, "
    "CAST(SUM(churn_flag) AS BIGINT) AS churned, "
    "CAST(SUM(CASE WHEN churn_flag = 0 THEN monthly_charges END) AS DOUBLE) AS active_mrr "
    "FROM {table} WHERE tenure >= 12 GROUP BY contract, internet_service"
)
VIEW_NAME = "churnscope_customers"


@query("src_sql_query", USER_QUERY.format(table="customers"), ("IO05",))
def src_sql_query(fr):
    """User SQL text run on Spark over the typed accounts registered as a view."""
    fr.acct.createOrReplaceTempView(VIEW_NAME)
    return io.read_query(fr.spark, USER_QUERY.format(table=VIEW_NAME))


@query(
    "sink_parquet_roundtrip",
    "SELECT * REPLACE (CAST(monthly_charges AS DOUBLE) AS monthly_charges, "
    "CAST(total_charges AS DOUBLE) AS total_charges) FROM customers",
    ("IO06", "IO07", "IO10"),
)
def sink_parquet_roundtrip(fr):
    """Typed accounts saved as Parquet clustered by churn flag, contract and
    tenure (the filter columns), then loaded back."""
    base = io.scratch_dir(fr.spark, "parquet")
    io.save_table(fr.acct, base, "customers", sort_by=["churn_flag", "contract", "tenure", "customer_id"])
    return decimals_as_double(io.load_table(fr.spark, base, "customers"))


ZORDER_COLUMNS = ["churn_flag", "contract", "tenure", "health_tier"]


@query(
    "zorder_tier_lookup",
    "SELECT customer_id, contract, tenure, churn_flag, health_score, health_tier FROM scores WHERE health_tier = 'At Risk'",
    ("IO10",),
)
def zorder_tier_lookup(fr):
    """Scored accounts saved along a Z curve over churn flag, contract, tenure
    and tier, with Bloom filters on the id; then the accounts of one tier, a
    filter on the last of the four columns."""
    base = io.scratch_dir(fr.spark, "zorder")
    io.save_table(fr.scored, base, "scores", sort_by=["customer_id"], zorder_by=ZORDER_COLUMNS, bloom=["customer_id"])
    kept = io.load_table(fr.spark, base, "scores").where("health_tier = 'At Risk'")
    return kept.select("customer_id", "contract", "tenure", "churn_flag", "health_score", "health_tier")


@query(
    "refreshed_scores",
    "SELECT customer_id, contract, tenure, churn_flag, health_score, health_tier FROM scores",
    ("IO04", "IO08", "IO09"),
)
def refreshed_scores(fr):
    """Scores of an older state of the accounts (one part of the ids with other
    tenures, another part missing), refreshed to the present one: only those
    parts are derived and written again."""
    base, parts = io.scratch_dir(fr.spark, "refresh"), 16
    part = refresh.part_of("customerID", parts)
    older = fr.raw.where(part != 5).withColumn("tenure", F.when(part == 3, F.lit(1)).otherwise(F.col("tenure")).cast("int"))

    def scores(raw):
        return score_accounts(build_accounts(raw))

    refresh.refresh_table(older, base, "scores", scores, "customerID", parts)
    done = refresh.refresh_table(fr.raw, base, "scores", scores, "customerID", parts)
    return refresh.read_table(fr.spark, done).select("customer_id", "contract", "tenure", "churn_flag", "health_score", "health_tier")
