"""Statistics (ST01-ST03): Mann-Whitney U test and Pearson correlations.

Mann-Whitney U (two-sided, normal approximation with tie correction and
continuity correction, the large-sample method of common statistics
libraries) is computed from a value histogram, never from pairs:

1. one aggregation gives, per distinct value, the count in each group
   (partial aggregation: rows never move, only per-task histograms);
2. a running count over the distinct values gives each value's average
   (tie-averaged) rank;
3. one aggregation over the histogram gives the rank sum, group sizes and
   the tie term; U, z and p are column arithmetic on that single row.

Step 2 is a distributed prefix sum over the histogram (``prefix_sums``:
range partitions, per-partition running sums, per-partition offsets), so
even a continuous column with billions of distinct values never meets in
one task.

The two-sided p-value needs the complementary error function, which
neither Spark nor SQL engines provide; ``erfc`` below is the published
Chebyshev fit (fractional error below 1.2e-7) written as a column
expression, so everything stays in the JVM.

Groups too small for the normal form take ``mann_whitney_exact``: the
permutation distribution of the rank sum, built tie block by tie block.

Correlations: one block of co-moments per task (see ``comoments``); a constant
column yields NULL instead of failing the job (ANSI mode raises on division by
zero).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import ratio, round_to
from churnscope.operators.comoments import blocks, correlation, pair_moments
from churnscope.operators.ranking import prefix_sums

# --------------------------------------------------------------------------
# FIXED VALUES: coefficients of the Chebyshev fit of erfc (published, Press
# et al., Numerical Recipes, section 6.2), innermost term last.
# --------------------------------------------------------------------------
ERFC_BIAS = -1.26551223
ERFC_COEFFS = [
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
]


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (column expression)."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + F.lit(ERFC_BIAS) + t * poly)


def log10_erfc(x: Column) -> Column:
    """log10 of ``erfc`` for x >= 0, also where erfc itself is below any double."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return (F.ln(t) - x * x + F.lit(ERFC_BIAS) + t * poly) / math.log(10.0)


def log10_erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = f"{ERFC_COEFFS[-1]}"
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"((ln({t}) - ({x}) * ({x}) + ({ERFC_BIAS}) + {t} * {poly}) / {math.log(10.0)!r})"


def erfc_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * ({x})))"
    poly = f"{ERFC_COEFFS[-1]}"
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + ({ERFC_BIAS}) + {t} * {poly}))"


def value_histogram(df: DataFrame, value: str, group: Column) -> DataFrame:
    """Per distinct ``value``: rows with ``group`` true (n1), false (n2)."""
    g = group.cast("boolean")
    return (
        df.where(F.col(value).isNotNull() & g.isNotNull())
        .groupBy(F.col(value).alias("v"))
        .agg(
            F.sum(F.when(g, 1).otherwise(0)).cast("bigint").alias("n1"),
            F.sum(F.when(g, 0).otherwise(1)).cast("bigint").alias("n2"),
        )
        .withColumn("c", F.col("n1") + F.col("n2"))
    )


def mann_whitney(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: n1, n2, U (of the first group), z, two-sided p and its log10
    (which keeps tiny p apart that round to 0), significance at 0.05, and U / (n1 n2) (the AUC of ``value`` for the first group).
    Empty groups or all-equal values give NULL z and p."""
    hist = prefix_sums(value_histogram(df, value, group), "v", ["c"])
    # Twice the rank sum of a value's rows, a whole number: exact in any order.
    twice = F.col("n1").cast("decimal(18,0)") * (F.col("c_before") * 2 + F.col("c") + 1).cast("decimal(19,0)")
    s = hist.agg(
        (F.sum(twice).cast("double") / 2.0).alias("r1"),
        F.sum("n1").cast("double").alias("n1"),
        F.sum("n2").cast("double").alias("n2"),
        F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c").cast("double")).alias("tie"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1.0) / 2.0
    u2 = n1 * n2 - u1
    mu = n1 * n2 / 2.0
    var = n1 * n2 / 12.0 * ((n + 1.0) - ratio(F.col("tie"), n * (n - 1.0)))
    sigma = F.when(var > 0, F.sqrt(var))
    z = ratio(F.greatest(u1, u2) - mu - 0.5, sigma)
    # Two-sided p = 2 * (1 - Phi(z)) = erfc(z / sqrt(2)).
    p = F.when(z.isNotNull(), F.least(erfc(z / math.sqrt(2.0)), F.lit(1.0)))
    log_p = F.when(z.isNotNull(), F.least(log10_erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0)), F.lit(0.0)))
    out = s.select(
        n1.cast("bigint").alias("n1"),
        n2.cast("bigint").alias("n2"),
        F.when((n1 > 0) & (n2 > 0), u1).alias("u_statistic"),
        F.when((n1 > 0) & (n2 > 0), round_to(z, 6)).alias("z_score"),
        F.when((n1 > 0) & (n2 > 0), round_to(p, 6)).alias("p_value"),
        F.when((n1 > 0) & (n2 > 0), round_to(log_p, 6)).alias("log10_p_value"),
    )
    return out.withColumns(
        {
            "significant": F.col("p_value") < 0.05,
            "auc": round_to(ratio(F.col("u_statistic"), F.col("n1") * F.col("n2")), 6),
        }
    )


# Bounds of the exact test: rows of the smaller sample, and of both.
EXACT_SMALLER = 8
EXACT_ROWS = 100


def exact_p_value(n1: np.ndarray, n2: np.ndarray) -> float:
    """Two-sided exact p of the rank sum: the share of all choices of the
    smaller sample out of the pooled rows that lie at least as far from the mean.

    ``n1`` and ``n2`` count the samples' rows per distinct value, ascending.  A
    state is (rows chosen, twice their rank sum); a tie block of c rows passes it
    on for each number t chosen from it, comb(c, t) times.  Twice the
    (tie-averaged) rank is whole, so all comparisons are exact."""
    n1, n2 = np.asarray(n1, np.int64), np.asarray(n2, np.int64)
    mine = n1 if n1.sum() <= n2.sum() else n2
    size = n1 + n2
    chosen, total = int(mine.sum()), int(size.sum())
    twice_rank = 2 * (np.cumsum(size) - size) + size + 1
    ways = np.zeros((chosen + 1, 2 * chosen * total + 1))
    ways[0, 0] = 1.0
    for c, r in zip(size.tolist(), twice_rank.tolist()):
        after = ways.copy()
        for t in range(1, min(c, chosen) + 1):
            after[t:, t * r :] += math.comb(c, t) * ways[: chosen + 1 - t, : ways.shape[1] - t * r]
        ways = after
    mean = chosen * (total + 1)
    far = np.abs(np.arange(ways.shape[1]) - mean) >= abs(int((mine * twice_rank).sum()) - mean)
    return float(ways[chosen][far].sum() / ways[chosen].sum())


def mann_whitney_exact(df: DataFrame, by: list[str], value: str, group: Column) -> DataFrame:
    """Exact two-sided test per small segment: rows (*by, n1, n2, u_statistic,
    p_value, significant), where the smaller sample has 1 to ``EXACT_SMALLER``
    rows and both together at most ``EXACT_ROWS``; ``mann_whitney`` is for the
    others.  Ties are permuted whole blocks at a time, so p is exact with them
    too; without ties it is the usual exact distribution of U.  A NULL segment
    key is a segment; rows with NULL value or group do not count.

    Sizes are known before a segment's values are gathered, so that no list holds
    more than ``EXACT_ROWS`` values; only counts per value move, never rows."""
    flag = group.cast("boolean")
    used = df.where(F.col(value).isNotNull() & flag.isNotNull())
    # one struct as key: its NULL fields compare equal, so the semi join needs no other key
    used = used.select(F.struct(*by).alias("segment"), F.col(value).alias("v"), flag.alias("one"))
    hist = used.groupBy("segment", "v").agg(F.count_if(F.col("one")).alias("n1"), F.count_if(~F.col("one")).alias("n2"))
    sizes = hist.groupBy("segment").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    sizes = sizes.where(F.least("n1", "n2").between(1, EXACT_SMALLER) & (F.col("n1") + F.col("n2") <= EXACT_ROWS))
    kept = hist.join(sizes.select("segment"), "segment", "left_semi")
    lists = kept.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("v", "n1", "n2"))).alias("h"))
    start = F.struct(F.lit(0.0).alias("u"), F.lit(0).cast("bigint").alias("below"))
    # U counts the pairs in which the first sample's value is larger, ties half
    u = F.aggregate(
        "h",
        start,
        lambda a, x: F.struct((a["u"] + x["n1"] * (a["below"] + x["n2"] / 2.0)).alias("u"), (a["below"] + x["n2"]).alias("below")),
        lambda a: a["u"],
    )
    lists = lists.select("segment", F.col("h.n1").alias("n1"), F.col("h.n2").alias("n2"), u.alias("u_statistic"))

    def p_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, others = batch.column("n1").to_pylist(), batch.column("n2").to_pylist()
            made = [pa.array([sum(c) for c in ones], pa.int64()), pa.array([sum(c) for c in others], pa.int64())]
            p = pa.array([exact_p_value(a, b) for a, b in zip(ones, others)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), *made, batch.column("u_statistic"), p], ["segment", "n1", "n2", "u_statistic", "p"])

    kind = lists.schema["segment"].dataType.simpleString()
    out = lists.mapInArrow(p_values, f"segment {kind}, n1 long, n2 long, u_statistic double, p double")
    out = out.select("segment.*", "n1", "n2", "u_statistic", round_to(F.col("p"), 6).alias("p_value"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def pearson_long(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Sample Pearson r per column pair: rows (a, b, r), 6 places.

    Each task sends one block of the moments of all pairs (``comoments``).
    Observations are pairwise-complete (a row counts for a pair only when both
    values are present); NULL for a constant column."""
    return correlation_rows(pair_moments(blocks(df, pairs)), pairs)


def correlation_rows(moments: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, r) from the (p, moments) of numbered pairs."""
    label = lambda side: F.element_at(F.array(*[F.lit(pair[side]) for pair in pairs]), F.col("p") + 1)
    return moments.select(label(0).alias("a"), label(1).alias("b"), round_to(correlation(F.col("moments")), 6).alias("r"))


def corr_with(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """ST02: r of each column with ``target`` (6 places) and its direction,
    ordered by r ascending."""
    present = [c for c in cols if c in df.columns]
    long = pearson_long(df, [(c, target) for c in present]).select(
        F.col("a").alias("feature"), F.col("r").alias("pearson_r")
    )
    direction = F.when(F.col("pearson_r") < 0, "negative").when(F.col("pearson_r") >= 0, "positive")
    return long.withColumn("direction", direction).orderBy(F.col("pearson_r").asc_nulls_last(), "feature")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """ST03: lower triangle (a after b in ``cols``) of the correlation matrix
    as long rows (feature_a, feature_b, r)."""
    present = [c for c in cols if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(present) for b in present[:i]]
    return pearson_long(df, pairs).select(
        F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), F.col("r").alias("pearson_r")
    )
