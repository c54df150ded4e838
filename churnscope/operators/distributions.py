"""Distribution data behind the charts (CH03, CH04, CH06) and the feature
summary (FE24).

* Kernel density: Gaussian kernel, Scott's bandwidth (sample standard
  deviation x n^(-1/5)), evaluated on a fixed grid.  Rows are first reduced
  to a value histogram per group (partial aggregation); each histogram row
  then emits one term per grid point (a fixed fan-out, ``explode`` of a
  grid sequence, no join), and the terms are summed per (group, point).
* Box statistics: exact quartiles per group, whiskers at the most extreme
  values within 1.5 IQR, found on the per-group value histogram joined
  with the per-group quartiles (one row per group).
* Histogram: 20 equal bins per group over the group's own range, last bin
  closed on the right; all bins are listed, empty ones with 0.  Binning
  also runs on the value histogram.
* Rows are reduced to (group, value, count) with partial aggregation
  before any join, so no step shuffles the rows by a group key that may
  hold most of them (churn status).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnscope.functions.numeric import mean, ratio, round_fine, round_to
from churnscope.operators.ranking import prefix_sums
from churnscope.operators.selection import quantiles


def kde_on_grid(
    df: DataFrame,
    group: str,
    value: str,
    start: int | None = None,
    stop: int | None = None,
    step: int = 1,
    digits: int = 10,
) -> DataFrame:
    """Gaussian KDE (Scott's rule) of ``value`` per ``group`` at the grid
    points start, start+step, ..., stop; by default from three bandwidths below
    the group's smallest value to three above its largest.  One row per
    (group, point)."""
    return kde_of_counts(value_counts_by_group(df, group, value), group, start, stop, step, digits)


def kde_of_counts(
    hist: DataFrame, group: str, start: int | None = None, stop: int | None = None, step: int = 1, digits: int = 10
) -> DataFrame:
    """``kde_on_grid`` from the (group, v, cnt) of ``value_counts_by_group``."""
    hist = hist.withColumn("cnt", F.col("cnt").cast("double"))
    n, total = F.sum("cnt"), F.sum(F.col("cnt") * F.col("v"))
    spread = F.sum(F.col("cnt") * F.col("v") * F.col("v")) - total * total / n
    # One row per group: the group count bounds it.  All from the histogram.
    stats = hist.groupBy(group).agg(
        n.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sqrt(F.greatest(F.coalesce(ratio(spread, n - 1), F.lit(0.0)), F.lit(0.0))).alias("sd"),
    ).withColumn("bw", F.col("sd") * F.pow(F.col("n"), -0.2))
    low = F.lit(start) if start is not None else F.floor(F.col("lo") - 3 * F.col("bw")).cast("int")
    high = F.lit(stop) if stop is not None else F.ceil(F.col("hi") + 3 * F.col("bw")).cast("int")
    with_bw = hist.join(stats, group, "inner")
    grid = F.explode(F.sequence(low, high, F.lit(step))).alias("x")
    terms = with_bw.select(group, "cnt", "v", "bw", "n", grid)
    zscore = ratio(F.col("x") - F.col("v"), F.col("bw"))
    contrib = F.col("cnt") * F.exp(-0.5 * zscore * zscore)
    norm = F.col("n") * F.col("bw") * math.sqrt(2.0 * math.pi)
    # n and bw are fixed per group, so grouping by them adds no split.
    dens = terms.groupBy(group, "x", "n", "bw").agg(F.sum(contrib).alias("_s"))
    dens = dens.withColumn("_d", ratio(F.col("_s"), norm))
    return dens.select(
        group, F.col("x").cast("int").alias("x"), round_fine(F.col("_d"), digits).alias("density")
    )


def value_counts_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, v, cnt): rows reduced to distinct values per group with
    partial aggregation, so later joins never move the rows themselves."""
    return (
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(group, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
    )


def quartiles(df: DataFrame, cols: list[str], group: str | None, names: list[str]) -> DataFrame:
    """(group, name, and the three exact quartiles under ``names``), 6 places."""
    long = quantiles(df, cols, [0.25, 0.5, 0.75], group)
    keys = [*([group] if group else []), "name"]
    return long.groupBy(*keys).agg(
        *[round_to(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(n) for p, n in zip((0.25, 0.5, 0.75), names)]
    )


def quartiles_of_counts(hist: DataFrame, group: str) -> DataFrame:
    """(group, q1, median, q3), exact, 6 places, from (group, v, cnt): running
    counts over all values in range partitions, then the values at the ranks."""
    ordered = prefix_sums(hist.select(F.struct(group, "v").alias("key"), "cnt"), "key", ["cnt"]).select("key.*", "cnt", "cnt_before")
    size = ordered.groupBy(group).agg(F.sum("cnt").alias("n"), F.min("cnt_before").alias("start"))
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    asked = size.select(F.col(group), "n", "start", F.explode(F.array(*[F.lit(p) for p in names])).alias("p"))
    at = (F.col("n") - 1) * F.col("p")
    asked = asked.withColumn("at", at).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    met = ordered.join(asked, group).where("rank >= cnt_before - start and rank < cnt_before - start + cnt")
    off = F.col("at") - F.floor("at")
    share = F.when(F.col("rank") == F.floor("at"), 1 - off).otherwise(off)
    each = met.groupBy(group, "p").agg(F.sum(F.col("v") * share).alias("value"))
    return each.groupBy(group).agg(*[round_to(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(name) for p, name in names.items()])


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n, min, quartiles, max, IQR and 1.5-IQR whiskers, all from
    the per-group value histogram."""
    quarter = quartiles(df.where(F.col(group).isNotNull()), [value], group, ["q1", "median", "q3"])
    return box_of_counts(value_counts_by_group(df, group, value), quarter, group)


def box_of_counts(hist: DataFrame, quarter: DataFrame, group: str) -> DataFrame:
    """``box_stats`` from the (group, v, cnt) and the quartiles of each group."""
    size = hist.groupBy(group).agg(F.sum("cnt").cast("bigint").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = size.join(quarter, group).select(group, "n", "min", "q1", "median", "q3", "max").withColumn(
        "iqr", round_to(F.col("q3") - F.col("q1"), 6)
    )
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    whiskers = (
        hist.join(q.select(group, "q1", "q3", "iqr"), group, "inner")
        .groupBy(group)
        .agg(
            F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("lower_whisker"),
            F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("upper_whisker"),
        )
    )
    return q.join(whiskers, group, "inner")


def equal_width_histogram(df: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """Per group, ``bins`` equal bins over [min, max] of that group; the last
    bin includes the maximum.  Empty bins are listed with count 0.  Binning
    runs on the per-group value histogram (distinct values), so the rows are
    never shuffled by the group key."""
    return histogram_of_counts(value_counts_by_group(df, group, value), group, bins)


def histogram_of_counts(hist: DataFrame, group: str, bins: int = 20) -> DataFrame:
    """``equal_width_histogram`` from (group, v, cnt)."""
    rng = hist.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    raw_bin = F.floor(ratio((F.col("v") - F.col("lo")) * bins, span))
    idx = F.when(span == 0, F.lit(0)).otherwise(F.least(raw_bin, F.lit(bins - 1))).cast("int")
    counts = (
        hist.join(rng, group, "inner")
        .groupBy(group, idx.alias("bin"))
        .agg(F.sum("cnt").cast("bigint").alias("count"))
    )
    all_bins = rng.select(group, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = all_bins.select(
        group,
        F.col("bin").cast("int").alias("bin"),
        round_to(F.col("lo") + F.col("bin") * span / bins, 6).alias("bin_start"),
        round_to(F.col("lo") + (F.col("bin") + 1) * span / bins, 6).alias("bin_end"),
    )
    return edges.join(counts, [group, "bin"], "left").select(
        group, "bin", "bin_start", "bin_end", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")
    )


def feature_summary(feat: DataFrame, cols: list[str], categorical: set[str]) -> DataFrame:
    """FE24: one row per feature with count, unique, top, freq (categorical)
    and mean, std, min, quartiles, max (numeric); the other fields NULL.
    Numeric moments come from one aggregation, quartiles from value histograms; categorical counts from
    one exploded (feature, value) aggregation; top ties break to the lowest
    value."""
    present = [c for c in cols if c in feat.columns]
    numeric = [c for c in present if c not in categorical]
    cats = [c for c in present if c in categorical]
    parts = []
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            x = F.col(c).cast("double")
            aggs += [
                F.count(x).cast("bigint").alias(f"n{i}"),
                round_to(mean(x), 6).alias(f"mean{i}"),
                round_to(F.stddev_samp(x), 6).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
            ]
        wide = feat.agg(*aggs)
        rows = [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"n{i}").alias("count"),
                F.lit(None).cast("double").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("double").alias("freq"),
                F.col(f"mean{i}").alias("mean"),
                F.col(f"std{i}").alias("std"),
                F.col(f"min{i}").alias("min"),
                F.col(f"max{i}").alias("max"),
            )
            for i, c in enumerate(numeric)
        ]
        quarter = quartiles(feat, numeric, None, ["p25", "p50", "p75"])
        one = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        joined = one.join(quarter, one["feature"] == quarter["name"], "left")
        parts.append(joined.select(*one.columns[:-1], "p25", "p50", "p75", "max"))
    if cats:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cats])
        vc = (
            feat.select(F.explode(pairs).alias("p"))
            .select("p.*")
            .where(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
        )
        # One row per (feature, value): bounded by the categories' domains.
        w = Window.partitionBy("feature").orderBy(F.col("cnt").desc(), F.col("value").asc())
        top = vc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
        tot = vc.groupBy("feature").agg(
            F.sum("cnt").cast("bigint").alias("count"), F.count(F.lit(1)).cast("bigint").alias("unique")
        )
        # unique and freq are doubles, as in a describe() table where the
        # numeric rows leave them empty.
        cat_rows = tot.join(top, "feature", "inner").select(
            "feature",
            "count",
            F.col("unique").cast("double").alias("unique"),
            F.col("value").alias("top"),
            F.col("cnt").cast("double").alias("freq"),
            *[F.lit(None).cast("double").alias(n) for n in ["mean", "std", "min", "p25", "p50", "p75", "max"]],
        )
        parts.append(cat_rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
