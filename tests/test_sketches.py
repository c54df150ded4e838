"""Mergeable counts and the one-read top-n."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnscope.operators import ranking, sketches
from churnscope.sources import io
from tests.conftest import plan_text


def rows(df):
    return {r.column_name: (r.n_rows, r.n_nulls, r["distinct"], r.duplicates) for r in df.collect()}


def test_counts_are_exact_below_the_sketch_size(spark):
    df = spark.sql("select if(id % 7 = 0, null, id % 50) as v, 'x' as w, if(id % 3 = 0, null, cast(id % 3 as string)) as part from range(3000)")
    got = rows(sketches.merged_counts(sketches.sketch_parts(df, ["v", "w"], "part")))
    assert got == rows(sketches.exact_counts(df, ["v", "w"]))
    assert got["w"] == (3000, 0, 1, 2999)


@pytest.mark.parametrize("lg", [8, 12])
def test_merged_parts_meet_the_stated_error(spark, lg):
    df = spark.range(60_000).selectExpr("id % 40000 as v", "cast(id % 9 as string) as part")
    sketch = sketches.sketch_parts(df, ["v"], "part", lg)
    assert sketch.agg(F.max(F.length("sketch"))).first()[0] <= 8 * (1 << lg) + 64  # bounded states
    found = rows(sketches.merged_counts(sketch, lg))["v"]
    assert abs(found[2] - 40_000) <= 40_000 * sketches.relative_error(lg)
    assert found[3] == 60_000 - found[2]


def test_stored_parts_are_replaced_and_added(spark):
    path = io.scratch_dir(spark, "sketch-test")
    one = spark.sql("select id as v, if(id < 10, 'a', null) as part from range(15)")
    two = spark.sql("select id + 100 as v, if(id < 5, 'a', 'b') as part from range(9)")
    for df in (one, two):
        sketches.store_parts(sketches.sketch_parts(df, ["v"], "part"), path)
    kept = {(r.part, r.n_rows) for r in sketches.stored_parts(spark, path).collect()}
    assert kept == {("a", 5), ("b", 4), (None, 5)}
    assert rows(sketches.merged_counts(sketches.stored_parts(spark, path)))["v"] == (14, 0, 14, 0)
    assert rows(sketches.merged_counts(sketches.stored_parts(spark, path).where("part = 'zz'"))) == {}


def test_values_kept_from_the_part_before(spark):
    df = spark.sql("select 'a' as part, id as v from range(10) union all select 'b', id + 4 from range(10) union all select 'c', null")
    got = {r.part: (r.before, r.kept, r.added) for r in sketches.kept_from_before(sketches.sketch_parts(df, ["v"], "part")).collect()}
    assert got == {"a": (None, None, None), "b": (10, 6, 4), "c": (10, 0, 0)}


def test_sketches_are_built_before_the_shuffle(spark):
    df = sketches.sketch_parts(spark.range(10).selectExpr("id as v", "'p' as part"), ["v"], "part")
    assert plan_text(df).count("partial_theta_sketch_agg") >= 1


def ranked(df, group, order, n):
    by = Window.partitionBy(*group)
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    out = df.withColumns({"rk": F.row_number().over(by.orderBy(*keys)), "size": F.count(F.lit(1)).over(by)})
    return sorted(map(repr, out.where(F.col("rk") <= n).collect()))


@pytest.mark.parametrize("held", [4, 1 << 16])
def test_top_n_with_size_equals_windows(spark, monkeypatch, held):
    monkeypatch.setattr(ranking, "HELD_ROWS", held)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "16")  # several batches a task
    try:
        _compare_top_n(spark)
    finally:
        spark.conf.set(batch, before)


def _compare_top_n(spark):
    pick = random.Random(5)
    data = [
        (pick.choice([None, "a", "b", "hot", "hot"]), pick.choice([None, 1, 2]), pick.choice([None, 1.5, float("nan"), -2.0]), pick.choice(["x", None, "é"]), i)
        for i in range(700)
    ]
    df = spark.createDataFrame(data, "g string, h int, d double, s string, id long").repartition(5)
    for group, order in (
        (["g"], [("d", False), ("s", True), ("id", True)]),
        (["g", "h"], [("d", True), ("s", False), ("id", False)]),
    ):
        got = ranking.top_n_with_size(df, group, order, 3, "rk", "size")
        assert sorted(map(repr, got.select(*df.columns, "rk", "size").collect())) == ranked(df, group, order, 3)
    empty = ranking.top_n_with_size(df.where("id < 0"), ["g"], [("id", True)], 3, "rk", "size")
    assert empty.collect() == []
