"""Numeric helpers shared by every operator.

The rules fix how numbers are produced so that two engines agree:

* ``round_to``: an exact decimal/integer input becomes a double ratio, the
  ratio is cast to ``decimal(18,6)`` and rounded half away from zero (the
  SQL ``ROUND`` on NUMERIC), then returned as a double.
* ``ratio``: division that yields NULL on a zero or NULL denominator.
* ``money_sum`` and ``round_money``: sums of money are exact decimals up to
  the final rounding, never float sums, so neither the order in which
  partitions are merged nor the size of the total can change a digit.
* ``mean``: ``sum / count`` on doubles (never ``avg`` of a decimal, whose
  result type differs between engines).

Each helper has a ``*_sql`` twin that writes the same arithmetic as SQL text
(used in the oracle queries, valid for Spark SQL and DuckDB alike).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_FOR_ROUNDING = "decimal(18,6)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: Column | str, digits: int) -> Column:
    """Round half away from zero at ``digits`` places; result is a double."""
    return F.round(_col(c).cast(DECIMAL_FOR_ROUNDING), digits).cast("double")


def round_to_sql(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(18,6)), {digits}) AS DOUBLE)"


def round_fine(c: Column | str, digits: int) -> Column:
    """Like ``round_to`` with more headroom for small values (densities)."""
    return F.round(_col(c).cast("decimal(24,14)"), digits).cast("double")


def round_fine_sql(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(24,14)), {digits}) AS DOUBLE)"


def round_money(c: Column, digits: int = 0) -> Column:
    """Round an exact decimal amount of any size half away from zero (38 digits:
    sums of whole tables included); result is a double."""
    return F.round(c.cast("decimal(38,6)"), digits).cast("double")


def round_money_sql(expr: str, digits: int = 0) -> str:
    return f"CAST(ROUND(CAST(({expr}) AS DECIMAL(38,6)), {digits}) AS DOUBLE)"


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double; NULL when ``den`` is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def ratio_sql(num: str, den: str) -> str:
    return f"(CAST(({num}) AS DOUBLE) / NULLIF(CAST(({den}) AS DOUBLE), 0))"


def pct(num: Column | str, den: Column | str, digits: int) -> Column:
    """``100 * num / den`` rounded by ``round_to``."""
    return round_to(ratio(_col(num).cast("double") * 100.0, den), digits)


def pct_sql(num: str, den: str, digits: int) -> str:
    return round_to_sql(ratio_sql(f"CAST(({num}) AS DOUBLE) * 100.0", den), digits)


def money(c: Column | str) -> Column:
    """A money value held as a double, re-read as its exact cents decimal."""
    return _col(c).cast("decimal(12,2)")


def money_sum(c: Column | str) -> Column:
    """Exact sum of a money column, a decimal; round it with ``round_money``."""
    return F.sum(money(c))


def money_sum_sql(expr: str) -> str:
    return f"SUM(CAST(({expr}) AS DECIMAL(12,2)))"


def mean(c: Column | str) -> Column:
    """Mean as ``sum / count`` of doubles; for integer-valued inputs it is exact."""
    return ratio(F.sum(_col(c).cast("double")), F.count(_col(c)))


def mean_sql(expr: str) -> str:
    return ratio_sql(f"SUM(CAST(({expr}) AS DOUBLE))", f"COUNT({expr})")


def money_mean(c: Column | str) -> Column:
    """Mean of a money column: exact decimal sum over count."""
    return ratio(F.sum(money(c)), F.count(_col(c)))


def money_mean_sql(expr: str) -> str:
    return ratio_sql(f"SUM(CAST(({expr}) AS DECIMAL(12,2)))", f"COUNT({expr})")


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is true, as bigint (0 on an empty input)."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def count_if_sql(cond: str) -> str:
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"
