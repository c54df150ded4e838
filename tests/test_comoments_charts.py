"""Co-moment blocks and the charts from one scan."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from churnscope.operators import comoments, distributions, stats
from churnscope.plans.charts import PAIRS, chart_cells, chart_table
from churnscope.plans.frames import Frames

COLS = ["a", "b", "c", "d"]


@pytest.fixture
def frame(spark):
    """Missing values, a large offset, a column that is constant where b is known."""
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b = rnd.normal(), rnd.normal() if i % 5 else None
        rows.append((float(a) + 1e9, b, 4.5 if b is not None else float(i), float("nan") if i % 11 == 0 else float(a + rnd.normal())))
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)


def test_blocks_equal_pairwise_complete_numpy(spark, frame):
    pairs = [(x, y) for i, x in enumerate(COLS) for y in COLS[:i]]
    got = {(r.a, r.b): r.r for r in stats.pearson_long(frame, pairs).collect()}
    data = frame.toPandas()
    for x, y in pairs:
        both = data[[x, y]].dropna()
        if both[x].nunique() == 1 or both[y].nunique() == 1:
            assert got[x, y] is None
        else:
            assert got[x, y] == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=2e-6)
    assert got["c", "b"] is None and got["d", "a"] > 0.5


def test_a_task_sends_one_row(frame):
    found = comoments.blocks(frame, [("a", "b"), ("c", "d")])
    assert found.count() <= frame.rdd.getNumPartitions()
    plan = stats.corr_matrix(frame, COLS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan


def test_blocks_join_in_any_split(frame):
    x = np.array(frame.toPandas()[COLS], float)
    whole = comoments.Block(4)
    whole.add(x)
    parts = comoments.Block(4)
    for piece in np.array_split(x, 7):
        one = comoments.Block(4)
        one.add(piece)
        one.add(piece[:0])
        parts.join(one)
    assert np.allclose(parts.co, whole.co, rtol=1e-6, atol=1e-6) and np.array_equal(parts.n, whole.n)
    assert np.array_equal(parts.low, whole.low) and np.allclose(parts.mean, whole.mean, rtol=1e-12)


def test_correlations_of_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert stats.corr_matrix(empty, ["a", "b"]).collect() == []
    nulls = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    assert [r.pearson_r for r in stats.corr_matrix(nulls, ["a", "b"]).collect()] == [None]


def test_quartiles_of_counts_equal_percentiles(spark):
    df = spark.range(500).selectExpr("cast(id % 3 as int) as g", "cast(pow(id % 41, 2) as double) as v")
    hist = distributions.value_counts_by_group(df, "g", "v")
    got = {r.g: (r.q1, r.median, r.q3) for r in distributions.quartiles_of_counts(hist, "g").collect()}
    want = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).collect()}
    assert {g: pytest.approx(v, abs=1e-6) for g, v in got.items()} == want


def test_cells_come_from_one_account_derivation(spark):
    plan = chart_cells(Frames(spark, SF_SMALL).feat)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1 and plan.count("Expand") == 1
    table = chart_table(Frames(spark, SF_SMALL).feat)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
    sizes = {r.chart: r["count"] for r in table.groupBy("chart").count().collect()}
    assert sizes["correlation"] == len(PAIRS) and sizes["overview"] == 1 and sizes["health_hist"] == 40 and sizes["charges_box"] == 16
