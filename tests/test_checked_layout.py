"""Data rules measured by the writing job; Z-ordered tables."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL, raw_row
from pyspark.sql import functions as F

from churnscope.operators import quality
from churnscope.operators.cleaning import clean
from churnscope.plans.frames import Frames
from churnscope.sources import io
from churnscope.streaming import exports


def _rules(df):
    return sorted((r.rule, r.violations, r.threshold, r.passed, r.detail) for r in df.collect())


def test_rules_of_the_write_equal_the_assertions(spark, tmp_path):
    df = Frames(spark, SF_SMALL).clean
    rules, passed = io.save_checked(df, str(tmp_path), "clean", sort_by=["churn_flag", "customer_id"])
    assert passed and _rules(rules) == _rules(quality.assertions(df))
    assert io.load_table(spark, str(tmp_path), "clean").exceptAll(df).count() == 0


def test_a_broken_rule_keeps_the_table_before(spark, make_raw, tmp_path):
    good = clean(make_raw([raw_row(cid="A1"), raw_row(cid="A2")]))
    bad = clean(make_raw([raw_row(cid="A1"), raw_row(cid="A1"), raw_row(cid="A3", tenure=-4)]))
    assert io.save_checked(good, str(tmp_path), "t")[1]
    rules, passed = io.save_checked(bad, str(tmp_path), "t")
    assert not passed and _rules(rules) == _rules(quality.assertions(bad))
    assert {r.rule for r in rules.where("not passed").collect()} == {"duplicate_customer_ids", "negative_tenure"}
    assert io.load_table(spark, str(tmp_path), "t").count() == 2 and io.load_table(spark, str(tmp_path), "t.rejected").count() == 3
    assert io.save_checked(good.limit(1), str(tmp_path), "t")[1] and io.load_table(spark, str(tmp_path), "t").count() == 1
    assert not [p for p in glob.glob(f"{tmp_path}/*") if ".staged-" in p or ".old-" in p]


def test_stream_batches_measure_the_rules(spark, make_raw, tmp_path):
    inbox = tmp_path / "inbox"
    io.write_raw_csv(make_raw([raw_row(cid="A1", tenure=-1), raw_row(cid="A2"), raw_row(cid="A3", monthly="250.00")]), str(inbox / "day1"))
    rows = exports.watched_stream(exports.clean_stream(exports.stream_raw_exports(spark, str(inbox / "*"))), "rules")
    q = exports.append_to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    found = exports.batch_rules(q, "rules")
    assert len(found) == 1 and found[0]["negative_tenure"] == 1 and found[0]["monthly_charges_over_200"] == 1


def _groups(path, column, value):
    """(row groups whose range holds the value, all row groups)."""
    held = total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        place = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(place).statistics
            held += s is None or not s.has_min_max or s.min <= value <= s.max
            total += 1
    return held, total


@pytest.mark.parametrize("column,value", [("d", "t7"), ("c", 11), ("b", "Two"), ("a", 1)])
def test_any_column_of_the_curve_skips_row_groups(spark, tmp_path, column, value):
    df = spark.range(40_000).selectExpr(
        "concat('id-', id) as id", "cast(pmod(hash(id, 1), 2) as int) as a", "element_at(array('Month', 'One', 'Two'), pmod(hash(id, 2), 3) + 1) as b",
        "cast(pmod(hash(id, 3), 72) as int) as c", "concat('t', pmod(hash(id, 4), 8)) as d",
    )
    small = {"parquet.block.size": "8192", "parquet.page.size.row.check.min": "50", "parquet.block.size.row.check.min": "50", "parquet.block.size.row.check.max": "200"}
    plain = io.save_table(df, str(tmp_path), "plain", sort_by=["a", "b", "c", "d", "id"], num_partitions=32, options=small)
    curve = io.save_table(df, str(tmp_path), "curve", sort_by=["id"], zorder_by=["a", "b", "c", "d"], num_partitions=32, bloom=["id"], options=small)
    assert io.load_table(spark, str(tmp_path), "curve").exceptAll(df).count() == 0
    held, total = _groups(curve, column, value)
    assert total >= 32 and held <= 0.75 * total
    if column == "d":  # the last column of a plain sort skips nothing to speak of
        assert held < 0.6 * _groups(plain, column, value)[0] / _groups(plain, column, value)[1] * total


def test_curve_takes_nulls_and_one_value(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, None, 1), (2.5, "y", 1)], "a double, b string, c int")
    keys = [r[0] for r in df.select(io.zorder_key(df, ["a", "b", "c"])).collect()]
    assert len(keys) == 3 and all(k >= 0 for k in keys)
    assert df.where(F.lit(False)).select(io.zorder_key(df.where(F.lit(False)), ["a", "b"])).collect() == []
