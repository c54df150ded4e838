"""Exact selection: any key, any id, in several rounds with small limits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.operators import selection


def _frame(spark, kind, n=3000):
    """Rows with a third of them on one key; ids of several shapes."""
    rnd = random.Random(kind)
    rows = []
    for i in range(n):
        ident = {
            "prefix": f"{'customer-of-the-same-shop-' * 3}{i:08d}",
            "nested": "a" * (i % 97) + "\x00" * (i % 3) + f"{i % 11}",
            "plain": f"K{rnd.randint(0, 10**9)}",
        }[kind]
        key = None if i % 17 == 0 else 0.5 if i % 3 == 0 else rnd.random() if i % 5 else float("nan") if i % 95 == 0 else rnd.choice([-0.0, 0.0, 1e300, -3.25])
        rows.append((ident, key, i))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id string, x double, num long").dropDuplicates(["id", "x"])


@pytest.mark.parametrize("kind", ["prefix", "nested", "plain"])
@pytest.mark.parametrize("limit", [1, 40])
def test_ntile_of_any_key_and_id(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(selection, "LIMIT", limit)
    df = _frame(spark, kind).withColumn("x", F.when(F.isnan("x"), float("inf")).otherwise(F.col("x"))).cache()
    got = df.withColumns(selection.ntile_columns(df, {"qa": F.col("x"), "qb": -F.col("x"), "qc": F.lit(1)}, "id", 7))
    for name, key in (("qa", F.col("x") + 0.0), ("qb", -F.col("x") + 0.0), ("qc", F.lit(1))):
        want = df.withColumn(name, F.ntile(7).over(Window.orderBy(key.asc_nulls_first(), "id")))
        assert got.select("id", "x", name).exceptAll(want.select("id", "x", name)).count() == 0
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_numeric_ids_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(selection, "LIMIT", 5)
    df = spark.createDataFrame([(i * 7919 % 1000 - 500, 1) for i in range(1000)], "id long, x int")
    got = df.withColumns(selection.ntile_columns(df, {"q": F.col("x")}, "id", 4))
    want = df.withColumn("q", F.ntile(4).over(Window.orderBy("x", "id")))
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_buckets(spark, n):
    df = spark.createDataFrame([(f"K{i}", i) for i in range(n)], "id string, x int")
    got = df.withColumns(selection.ntile_columns(df, {"q": F.col("x")}, "id", 5))
    assert sorted(r.q for r in got.collect()) == list(range(1, n + 1))


@pytest.mark.parametrize("limit", [1, 100])
def test_quantiles_of_ratios_and_heavy_values(spark, monkeypatch, limit):
    """Values within [0, 1], where cells of unit width would be one cell."""
    monkeypatch.setattr(selection, "LIMIT", limit)
    df = spark.range(4000).selectExpr(
        "id % 3 as g", "rand(5) as x", "case when id % 3 = 0 then 0.25 else rand(6) * 1e-9 end as y", "case when id % 7 = 0 then null else id end as z"
    ).cache()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.name, r.p): r.value for r in selection.quantiles(df, ["x", "y", "z"], probs, "g").collect()}
    for r in df.groupBy("g").agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "xyz"]).collect():
        for c in "xyz":
            assert [got[r.g, c, p] for p in probs] == pytest.approx(r[c], rel=1e-12, abs=0)


def test_rounds_read_few_rows_and_end_bounded(spark, monkeypatch):
    """No part that is sorted holds more than LIMIT rows, and the rounds are few."""
    monkeypatch.setattr(selection, "LIMIT", 500)
    rounds, sorted_rows = [], []
    parts, entries = selection._parts, selection._entries
    monkeypatch.setattr(selection, "_parts", lambda *a: rounds.append(1) or parts(*a))

    def watched(rows, spans, *rest):
        made = entries(rows, spans, *rest)
        if not any(s.splitters for s in spans) and all(s.count <= 500 for s in spans):
            sorted_rows.extend(r["count"] for r in made.groupBy("part").count().collect())
        return made

    monkeypatch.setattr(selection, "_entries", watched)
    df = spark.range(200_000).selectExpr("concat('same-prefix-of-every-id-', id) as id", "case when id % 3 = 0 then 1.5 else rand(3) * 3 end as x").cache()
    got = df.withColumns(selection.ntile_columns(df, {"q": F.col("x")}, "id", 5))
    assert [r["count"] for r in got.groupBy("q").count().orderBy("q").collect()] == [40_000] * 5
    assert len(rounds) <= 8 and sorted_rows and max(sorted_rows) <= 500


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_GROUPS", 10)
    with pytest.raises(ValueError, match="groups"):
        selection.quantiles(spark.range(50).selectExpr("id as g", "id as x"), ["x"], [0.5], "g")


def test_rows_are_derived_once(spark, monkeypatch):
    """All rounds read the keys that the first job wrote."""
    monkeypatch.setattr(selection, "LIMIT", 50)
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = F.udf(count, "double")
    df = spark.range(2000).select(F.col("id").alias("num"), (F.col("id") % 7).cast("double").alias("y"))
    found = selection.select_ranks(df.select("num", counted("y").alias("x")), {"x": F.col("x")}, lambda n: [400, 800, 1600], "num")
    assert seen.value == 2000
    n, rows = found[0, "x"]
    order = sorted((float(i % 7), i) for i in range(2000))
    assert n == 2000 and [rows[k][0] for k in (400, 800, 1600)] == [order[k][0] for k in (400, 800, 1600)]
    assert [int(rows[k][1][1:]) - (1 << 63) for k in (400, 800, 1600)] == [order[k][1] for k in (400, 800, 1600)]
