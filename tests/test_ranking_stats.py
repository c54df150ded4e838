"""Properties: distributed ranks equal window ranks; statistics equal brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.operators import ranking, stats


def _skewed_frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows share one hot value.
        v = 42 if i % 3 == 0 else rnd.randint(0, 60)
        rows.append((f"K{i:06d}", v, rnd.choice([None, 1.5, 2.5, 3.0]) if i % 11 == 0 else float(v)))
    return spark.createDataFrame(rows, "id string, v int, w double")


@pytest.mark.parametrize("parts", [None, 1, 4, 9])
def test_global_rank_equals_row_number(spark, parts):
    df = _skewed_frame(spark)
    order = [F.col("v").desc(), "id"]
    got = ranking.global_rank(df, order, "r", num_partitions=parts)
    want = df.withColumn("r", F.row_number().over(Window.orderBy(*order)))
    assert got.select("id", "r").exceptAll(want.select("id", "r")).count() == 0
    assert got.count() == df.count()


@pytest.mark.parametrize("n,buckets", [(7, 5), (3000, 5), (1, 5), (12, 4)])
def test_global_ntile_equals_ntile(spark, n, buckets):
    df = _skewed_frame(spark, n)
    order = [F.col("w").asc_nulls_first(), "id"]
    got = ranking.global_ntile(df, order, buckets, "q", num_partitions=3)
    want = df.withColumn("q", F.ntile(buckets).over(Window.orderBy(*order)))
    assert got.select("id", "q").exceptAll(want.select("id", "q")).count() == 0


def test_ntile_remainder_sizes(spark):
    df = spark.createDataFrame([(f"K{i}", i) for i in range(7)], "id string, v int")
    got = ranking.global_ntile(df, ["v", "id"], 5, "q", num_partitions=2)
    sizes = sorted((r.q, r["count"]) for r in got.groupBy("q").count().collect())
    assert sizes == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 1)]


def test_global_rank_moves_only_partition_counts_to_one_partition(spark):
    import re

    from conftest import plan_text

    df = _skewed_frame(spark, 200)
    plan = plan_text(ranking.global_rank(df, ["v", "id"], "r"))
    blocks = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", plan)
    # Only the per-partition counts (one row per range partition) are
    # gathered; the rows themselves never leave their range partition.
    assert blocks, plan
    for cols in blocks:
        names = {c.split("#")[0].strip() for c in cols.split(",")}
        assert names <= {"_gr_pid", "_gr_n", "count"}, names


def test_top_n_per_group_uses_window_group_limit(spark):
    df = _skewed_frame(spark, 500)
    top = ranking.top_n_per_group(df, ["v"], [F.col("w").desc(), "id"], 3, "rk")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.groupBy("v").count().where("count > 3").count() == 0


def _brute_mann_whitney(x, y):
    n1, n2 = len(x), len(y)
    u = 0.0
    for a in x:
        for b in y:
            u += 1.0 if a > b else (0.5 if a == b else 0.0)
    allv = sorted(x + y)
    counts = {}
    for v in allv:
        counts[v] = counts.get(v, 0) + 1
    n = n1 + n2
    tie = sum(c ** 3 - c for c in counts.values())
    sigma = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sigma
    return u, z, math.erfc(z / math.sqrt(2.0))


@pytest.mark.parametrize("seed,shift", [(1, 0), (2, 4), (3, 15)])
def test_mann_whitney_matches_brute_force(spark, seed, shift):
    rnd = random.Random(seed)
    x = [rnd.randint(0, 30) + shift for _ in range(150)]
    y = [rnd.randint(0, 30) for _ in range(220)]
    df = spark.createDataFrame([(v, 1) for v in x] + [(v, 0) for v in y], "t int, g int")
    r = stats.mann_whitney(df, "t", F.col("g") == 1).first()
    u, z, p = _brute_mann_whitney(x, y)
    assert r.u_statistic == u
    assert abs(r.z_score - z) < 1e-5
    assert abs(r.p_value - p) < 2e-6
    assert r.n1 == 150 and r.n2 == 220
    assert r.significant == (p < 0.05)


def test_mann_whitney_one_sided_and_constant(spark):
    one_sided = spark.createDataFrame([(1, 1), (2, 1)], "t int, g int")
    r = stats.mann_whitney(one_sided, "t", F.col("g") == 1).first()
    assert r.u_statistic is None and r.p_value is None
    constant = spark.createDataFrame([(5, 1), (5, 0), (5, 1)], "t int, g int")
    r = stats.mann_whitney(constant, "t", F.col("g") == 1).first()
    assert r.z_score is None and r.p_value is None


def test_tiny_p_values_stay_apart(spark):
    df = spark.createDataFrame([(v, 1) for v in range(100, 300)] + [(v, 0) for v in range(90)], "t int, g int")
    r = stats.mann_whitney(df, "t", F.col("g") == 1).first()
    _, _, p = _brute_mann_whitney(list(range(100, 300)), list(range(90)))
    assert p < 1e-12 and r.p_value == 0 and abs(r.log10_p_value - math.log10(p)) < 1e-5


def test_erfc_fit_accuracy(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(stats.erfc(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - math.erfc(x)) <= 1.3e-7 * math.erfc(x) + 1e-300


def test_correlations_match_numpy_and_constant_is_null(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    a = rnd.normal(size=400)
    b = 0.5 * a + rnd.normal(size=400)
    c = np.full(400, 3.0)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    m = {(r.feature_a, r.feature_b): r.pearson_r for r in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert abs(m[("b", "a")] - np.corrcoef(a, b)[0, 1]) < 1e-6
    assert m[("c", "a")] is None and m[("c", "b")] is None


def test_mode_and_percentile_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 10.0)], "k string, v double")
    r = df.agg(F.mode("k", deterministic=True).alias("m"), F.percentile("v", 0.5).alias("p")).first()
    assert r.m == "a" and r.p == 2.5


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_prefix_sums_match_window(spark, parts):
    rnd = random.Random(parts)
    rows = [(v, rnd.randint(0, 9), rnd.randint(0, 5)) for v in range(0, 600, 3)]
    df = spark.createDataFrame(rows, "v int, a int, b int")
    got = ranking.prefix_sums(df, "v", ["a", "b"], num_partitions=parts)
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("v", "a", "b", F.coalesce(F.sum("a").over(w), F.lit(0)).alias("a_before"),
                     F.coalesce(F.sum("b").over(w), F.lit(0)).alias("b_before"))
    assert got.count() == df.count()
    assert got.exceptAll(want).count() == 0


def test_ntile_by_value_cells_equals_ntile(spark):
    from pyspark.sql import Window

    from churnscope.operators.selection import ntile_columns

    for n in (0, 3, 7, 200):
        rows = [(f"A{(i * 7919) % 1000:019d}", None if i % 17 == 3 else i % 4, float(i % 9)) for i in range(n)]
        df = spark.createDataFrame(rows, "id string, a int, b double")
        got = df.withColumns(ntile_columns(df, {"qa": F.col("a"), "qb": -F.col("b")}, "id", 5))
        want = {
            (r.id, r.qa, r.qb)
            for r in df.select(
                "id",
                F.ntile(5).over(Window.orderBy(F.col("a").asc_nulls_first(), "id")).alias("qa"),
                F.ntile(5).over(Window.orderBy(F.col("b").desc(), "id")).alias("qb"),
            ).collect()
        }
        assert {(r.id, r.qa, r.qb) for r in got.collect()} == want


def test_histogram_quantiles_equal_percentile(spark):
    from churnscope.operators.selection import quantiles

    rows = [(i % 3 or None, float(i * 37 % 101) / 4 - 5, None if i % 5 else i) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = {(r.g, r.name, r.p): r.value for r in quantiles(df, ["x", "y"], [0.25, 0.5, 1.0], "g").collect()}
    for r in df.groupBy("g").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias(c) for c in "xy"]).collect():
        for c in "xy":
            for p, v in zip((0.25, 0.5, 1.0), r[c]):
                assert abs(got[(r.g, c, p)] - v) < 1e-9


def _brute_exact(x, y):
    """Every choice of len(x) of the pooled rows."""
    from itertools import combinations

    u = lambda a, b: sum((v > w) + 0.5 * (v == w) for v in a for w in b)
    pool, mean = x + y, len(x) * len(y) / 2
    seen, hit, n = abs(u(x, y) - mean), 0, 0
    for some in combinations(range(len(pool)), len(x)):
        rest = [pool[i] for i in range(len(pool)) if i not in some]
        hit += abs(u([pool[i] for i in some], rest) - mean) >= seen
        n += 1
    return u(x, y), hit / n


def test_exact_mann_whitney_matches_every_permutation(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for seg, (n1, n2, top) in enumerate([(3, 5, 100), (5, 3, 2), (1, 6, 9), (4, 4, 5), (2, 9, 3), (6, 5, 50)]):
        key = None if seg == 4 else f"s{seg}"
        x, y = [rnd.randint(0, top) for _ in range(n1)], [rnd.randint(0, top) for _ in range(n2)]
        rows += [(key, "k", v, 1) for v in x] + [(key, "k", v, 0) for v in y]
        want[key] = (n1, n2, *_brute_exact(x, y))
    rows += [("one-sided", "k", 1, 1), ("s0", "k", None, 1), ("s1", "k", 5, None)]
    rows += [("large", "k", i, int(i < 3)) for i in range(stats.EXACT_ROWS + 1)]
    rows += [("both", "k", i, i % 2) for i in range(2 * stats.EXACT_SMALLER + 2)]
    df = spark.createDataFrame(rows, "seg string, other string, t int, g int")
    got = {r.seg: r for r in stats.mann_whitney_exact(df, ["seg", "other"], "t", F.col("g") == 1).collect()}
    assert set(got) == set(want)
    for key, (n1, n2, u, p) in want.items():
        assert (got[key].n1, got[key].n2, got[key].u_statistic) == (n1, n2, u)
        assert abs(got[key].p_value - p) < 1e-6 and got[key].significant == (got[key].p_value < 0.05)
    assert stats.mann_whitney_exact(df.limit(0), ["seg"], "t", F.col("g") == 1).collect() == []


def test_exact_p_value_of_separated_samples():
    import numpy as np

    one = np.array([0] * 20 + [1] * 8)
    assert abs(stats.exact_p_value(one, 1 - one) - 2 / math.comb(28, 8)) < 1e-15
    assert stats.exact_p_value(np.array([4]), np.array([7])) == 1.0
