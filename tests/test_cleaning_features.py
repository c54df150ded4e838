"""Micro-fixtures for the cleaning, typing, feature and score rules."""

from __future__ import annotations

import pytest

from conftest import raw_row
from churnscope.operators import cleaning, features, scoring


def test_blank_and_bad_totals(make_raw):
    rows = [
        raw_row(cid="A1", total="", monthly="20.00"),
        raw_row(cid="A2", total=" ", monthly="21.00"),
        raw_row(cid="A3", total=None, monthly="22.00"),
        raw_row(cid="A4", total="abc", monthly="23.00"),
        raw_row(cid="A5", total="29.85", monthly="24.00"),
        raw_row(cid="A6", total="\t", monthly="25.00"),
    ]
    df = cleaning.clean(make_raw(rows))
    got = {r.customer_id: r.total_charges for r in df.collect()}
    assert got == {"A1": 20.0, "A2": 21.0, "A3": 22.0, "A4": None, "A5": 29.85, "A6": 25.0}
    typed = {r.customer_id: r.total_charges for r in cleaning.build_accounts(make_raw(rows)).collect()}
    assert str(typed["A2"]) == "21.00" and typed["A4"] is None and str(typed["A5"]) == "29.85"


def test_whitespace_is_stripped_tabs_too(make_raw):
    rows = [raw_row(cid=" A1\t", contract="\tOne year  ", payment=" Mailed check\n")]
    r = cleaning.clean(make_raw(rows)).collect()[0]
    assert (r.customer_id, r.contract, r.payment_method) == ("A1", "One year", "Mailed check")


def test_senior_and_churn_flag(make_raw):
    rows = [
        raw_row(cid="A1", senior=0, churn="Yes"),
        raw_row(cid="A2", senior=1, churn="No"),
        raw_row(cid="A3", senior=2, churn=None),
    ]
    got = {r.customer_id: (r.senior_citizen, r.churn_flag) for r in cleaning.clean(make_raw(rows)).collect()}
    assert got == {"A1": ("No", 1), "A2": ("Yes", 0), "A3": (None, 0)}


def _feat(make_raw, rows):
    return {r.customer_id: r for r in features.engineer_features(cleaning.clean(make_raw(rows))).collect()}


def test_tenure_edges(make_raw):
    tenures = [-1, 0, 5, 6, 12, 13, 24, 25, 48, 49, 72, 73, None]
    rows = [raw_row(cid=f"A{i:02d}", tenure=t) for i, t in enumerate(tenures)]
    f = _feat(make_raw, rows)
    bands = [f[f"A{i:02d}"].tenure_bucket for i in range(len(tenures))]
    assert bands == [None, "0-12m", "0-12m", "0-12m", "0-12m", "13-24m", "13-24m", "25-48m", "25-48m",
                     "49-72m", "49-72m", None, None]
    new = [f[f"A{i:02d}"].is_new_customer for i in range(len(tenures))]
    assert new[2] == 1 and new[3] == 0 and new[-1] == 0
    assert f["A11"].health_score is None and f["A11"].health_tier is None  # tenure 73
    assert f["A00"].health_score is None  # tenure -1
    typed = {r.customer_id: r.tenure_bucket for r in cleaning.build_accounts(make_raw(rows)).collect()}
    assert typed["A01"] == "0-12 months" and typed["A11"] is None


def test_unknown_contract(make_raw):
    rows = [raw_row(cid="A1", contract="Three year"), raw_row(cid="A2", contract=None)]
    f = _feat(make_raw, rows)
    for cid in ("A1", "A2"):
        assert f[cid].contract_ordinal is None
        assert f[cid].health_score is None and f[cid].health_tier is None
    scored = {r.customer_id: r for r in scoring.score_accounts(cleaning.build_accounts(make_raw(rows))).collect()}
    assert scored["A1"].health_score is None and scored["A1"].health_tier is None


def test_service_mix(make_raw):
    none = ("No",) * 6
    tv_only = ("No", "No", "No", "No", "Yes", "No")
    sec_only = ("Yes", "No", "No", "No", "No", "No")
    all6 = ("Yes",) * 6
    null_col = (None, "No", "No", "No", "Yes", "No")
    rows = [
        raw_row(cid="A1", services=none),
        raw_row(cid="A2", services=tv_only),
        raw_row(cid="A3", services=sec_only),
        raw_row(cid="A4", services=all6),
        raw_row(cid="A5", services=null_col),
    ]
    f = _feat(make_raw, rows)
    assert [f[c].num_services for c in ("A1", "A2", "A3", "A4", "A5")] == [0, 1, 1, 6, 1]
    assert [f[c].is_streaming_only for c in ("A1", "A2", "A3", "A4", "A5")] == [0, 1, 0, 0, 1]
    assert [f[c].service_depth for c in ("A1", "A2", "A3", "A4")] == ["None", "Low (1-2)", "Low (1-2)", "High (5-6)"]


def test_has_internet_null_counts_as_internet(make_raw):
    rows = [raw_row(cid="A1", internet=None), raw_row(cid="A2", internet="No"),
            raw_row(cid="A3", internet="Fiber optic")]
    f = _feat(make_raw, rows)
    assert [(f[c].has_internet, f[c].has_fiber) for c in ("A1", "A2", "A3")] == [(1, 0), (0, 0), (1, 1)]


@pytest.mark.parametrize(
    "raw_points,score0,score1,tier",
    [
        (15, 14, 14.3, "At Risk"),
        (40, 38, 38.1, "At Risk"),
        (41, 39, 39.0, "At Risk"),
        (42, 40, 40.0, "Needs Attention"),
        (72, 69, 68.6, "Needs Attention"),
        (73, 70, 69.5, "Healthy"),
        (105, 100, 100.0, "Healthy"),
    ],
)
def test_score_edges(spark, raw_points, score0, score1, tier):
    from pyspark.sql import functions as F

    from churnscope.functions.numeric import round_to

    df = spark.range(1).select(F.lit(raw_points).alias("p"))
    s1 = df.select(round_to(F.least(F.greatest(F.col("p").cast("double") / 105 * 100.0, F.lit(0.0)), F.lit(100.0)), 1)).first()[0]
    s0 = df.select(F.least(round_to(F.col("p").cast("double") * 100.0 / 105, 0), F.lit(100.0))).first()[0]
    assert (s0, s1) == (score0, score1)
    tier1 = "At Risk" if s1 <= 39 else ("Needs Attention" if s1 <= 69 else "Healthy")
    tier0 = "Healthy" if s0 >= 70 else ("Needs Attention" if s0 >= 40 else "At Risk")
    assert tier0 == tier1 == tier


def test_division_by_zero_gives_null(make_raw):
    rows = [raw_row(cid="A1", tenure=0, monthly="0.00", total="")]
    f = _feat(make_raw, rows)
    assert f["A1"].tenure_normalized is None  # max tenure is 0
    assert f["A1"].charge_consistency_ratio is None  # monthly 0


def test_feature_frame_has_44_columns_and_keeps_rows(spark):
    from churnscope.plans.frames import Frames

    fr = Frames(spark, "/root/testdata/sf0.001")
    assert len(fr.feat.columns) == 44
    assert fr.feat.count() == fr.raw.count()


def test_cleaning_report_and_validate(make_raw):
    from churnscope.operators import quality

    rows = [raw_row(cid="A1", total=" "), raw_row(cid="A2", total="x")]
    rep = {r.metric: r.value for r in cleaning.cleaning_report(make_raw(rows)).collect()}
    assert rep["total_charges_imputed"] == 1 and rep["total_charges_nulls_after_coerce"] == 1
    assert rep["nulls.total_charges"] == 1 and rep["total_rows"] == 2 and rep["total_cols"] == 22

    bad = [raw_row(cid="B0", tenure=-1), raw_row(cid="B1", monthly="201.00")]
    bad += [raw_row(cid=f"L{i}", monthly="100.00", total="10.00") for i in range(21)]
    with pytest.raises(ValueError) as err:
        quality.validate(cleaning.clean(make_raw(bad)))
    msg = str(err.value)
    assert "negative_tenure" in msg and "monthly_charges_over_200" in msg and "total_below_90pct" in msg
    assert quality.validate(cleaning.clean(make_raw([raw_row()])))


def test_duplicate_counts_sql_vs_pandas_rule(make_raw):
    from churnscope.operators import quality

    rows = [raw_row(cid="x"), raw_row(cid="x"), raw_row(cid=None), raw_row(cid=None)]
    raw = make_raw(rows)
    assert quality.duplicate_ids(cleaning.build_accounts(raw)).first().duplicate_count == 3
    rules = {r.rule: r.violations for r in quality.assertions(cleaning.clean(raw)).collect()}
    assert rules["duplicate_customer_ids"] == 2


def test_empty_table_aggregates(make_raw):
    from churnscope.operators import quality, revenue

    raw = make_raw([])
    acct = cleaning.build_accounts(raw)
    s = quality.summary(acct).first()
    assert s.total_customers == 0 and s.total_mrr is None
    r = revenue.revenue_overview(acct).first()
    assert r.active_customers == 0 and r.current_mrr is None
