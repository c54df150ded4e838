"""Counts from stored sketches (Q01, Q03, FE24) against the exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnscope.operators import sketches
from churnscope.plans.registry import query
from churnscope.session import ensure_checkpoint_dir
from churnscope.sources import io

COUNTED = ["customer_id", "tenure", "monthly_charges", "total_charges"]
COMPARED = ["tenure", "num_services", "payment_method"]


def _counts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS n_nulls, "
        f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS distinct_values, CAST(COUNT({c}) - COUNT(DISTINCT {c}) AS BIGINT) AS duplicates, "
        "TRUE AS sketch_within_error FROM customers"
        for c in COUNTED
    )


@query("dq_sketch_counts", _counts_sql(), ("Q01", "Q03", "FE24"))
def dq_sketch_counts(fr):
    """Sketches of the accounts stored per contract in two deliveries, the later
    one replacing a part that came short in the first; merged, and held against
    the exact distinct and duplicate counts (three standard errors)."""
    path = f"{io.scratch_dir(fr.spark, 'sketches')}/counts"
    late = F.col("contract") == "Two year"
    first = fr.acct.where(~late | late.isNull() | (F.col("tenure") > 12))
    sketches.store_parts(sketches.sketch_parts(first, COUNTED, "contract"), path)
    sketches.store_parts(sketches.sketch_parts(fr.acct.where(late), COUNTED, "contract"), path)
    merged = sketches.merged_counts(sketches.stored_parts(fr.spark, path))
    merged = merged.select("column_name", F.col("n_rows").alias("_rows"), F.col("n_nulls").alias("_nulls"), F.col("distinct").alias("_distinct"))
    off = F.abs(F.col("_distinct") - F.col("distinct"))
    return sketches.exact_counts(fr.acct, COUNTED).join(merged, "column_name").select(
        "column_name", "n_rows", "n_nulls", F.col("distinct").alias("distinct_values"), "duplicates",
        (
            (F.col("_rows") == F.col("n_rows")) & (F.col("_nulls") == F.col("n_nulls"))
            & (off <= F.col("distinct") * sketches.relative_error())
        ).alias("sketch_within_error"),
    )


def _kept_sql() -> str:
    parts = "SELECT contract, LAG(contract) OVER (ORDER BY contract) AS last FROM (SELECT DISTINCT contract FROM customers) d"
    rows = []
    for c in COMPARED:
        old = f"SELECT DISTINCT {c} FROM customers WHERE contract = p.last AND {c} IS NOT NULL"
        new = f"SELECT DISTINCT {c} FROM customers WHERE contract = p.contract AND {c} IS NOT NULL"
        count = lambda name, sql: f"CASE WHEN p.last IS NOT NULL THEN CAST((SELECT COUNT(*) FROM ({sql}) v) AS BIGINT) END AS {name}"
        rows.append(
            f"SELECT '{c}' AS column_name, p.contract AS part, {count('before', old)}, {count('kept', f'{old} INTERSECT {new}')}, "
            f"{count('added', f'{new} EXCEPT {old}')} FROM ({parts}) p"
        )
    return " UNION ALL ".join(rows)


@query("dq_values_kept", _kept_sql(), ("Q01", "Q03"))
def dq_values_kept(fr):
    """Values of one contract that the contract before it (in name order) has too,
    and those it adds, from sketches (exact for these columns: few values).  The
    accounts are read once: the sketches are fixed by a reliable checkpoint."""
    ensure_checkpoint_dir(fr.spark)
    parts = sketches.sketch_parts(fr.acct, COMPARED, "contract").select("part", "column_name", "sketch")
    return sketches.kept_from_before(parts.checkpoint())
