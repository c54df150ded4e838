"""Refresh of changed parts only; survival curves and log-rank tests."""

from __future__ import annotations

import glob
import math
import os
import random

import pytest
from conftest import raw_row
from pyspark.sql import functions as F

from churnscope.operators import survival
from churnscope.operators.cleaning import build_accounts
from churnscope.operators.scoring import score_accounts
from churnscope.sources import refresh


def _scores(raw):
    return score_accounts(build_accounts(raw))


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_refresh_rewrites_only_changed_parts(spark, make_raw, tmp_path):
    rows = [raw_row(cid=f"A{i:03d}", tenure=i % 60, total=" " if i % 9 == 0 else "100.00") for i in range(200)]
    args = (str(tmp_path), "scores", _scores, "customerID", 8)
    first = refresh.refresh_table(make_raw(rows), *args)
    assert len(first.rewritten) == 8 and first.unchanged == 0
    before = _files(first.path)
    assert refresh.refresh_table(make_raw(list(reversed(rows))).repartition(3), *args).rewritten == ()
    assert _files(first.path) == before

    new = list(rows)
    new[17] = raw_row(cid="A017", tenure=59, total="100.00")
    new[40] = raw_row(cid="A040", tenure=40, internet=None, total="100.00")
    frame = make_raw(new)
    touched = {r[0] for r in frame.where("customerID in ('A017', 'A040')").select(refresh.part_of("customerID", 8)).collect()}
    done = refresh.refresh_table(frame, *args)
    assert set(done.rewritten) == touched and done.unchanged == 8 - len(touched)
    after = _files(done.path)
    assert {f for f in before if f in after} == {f for f in before if int(f.split("part=")[1].split("/")[0]) not in touched}
    assert all(before[f] == after[f] for f in before if f in after)
    got = refresh.read_table(spark, done)
    assert got.exceptAll(_scores(frame)).count() == 0 and got.count() == 200

    lost = next(iter(set(range(8)) - touched))
    fewer = frame.where(refresh.part_of("customerID", 8) != lost)
    done = refresh.refresh_table(fewer, *args)
    assert done.rewritten == () and done.removed == (lost,)
    assert refresh.read_table(spark, done).exceptAll(_scores(fewer)).count() == 0


def test_null_and_shifted_values_change_the_fingerprint(spark):
    frames = [spark.createDataFrame([("k", a, b)], "id string, a string, b string") for a, b in ((None, "x"), ("x", None), ("x", "x"), ("", "x"))]
    assert len({tuple(refresh.fingerprints(f, "id", 2).first())[1:] for f in frames}) == 4


def _curve(rows):
    """Survival and Greenwood's error at each time, by definition."""
    s, g, out = 1.0, 0.0, {}
    for t in sorted({t for t, _ in rows}):
        n = sum(u >= t for u, _ in rows)
        d = sum(u == t and e for u, e in rows)
        s *= 1 - d / n
        g += d / (n * (n - d)) if n > d else 0.0
        out[t] = (n, s, s * math.sqrt(g))
    return out


@pytest.fixture
def lives(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randint(0, 12 + 3 * k), int(rnd.random() < 0.3 + 0.2 * k)) for k, g in enumerate("abc") for _ in range(70)]
    rows += [("end", 3, 1), ("end", 5, 1), ("flat", 4, 0), (None, 1, 1), ("a", None, 1), ("b", 2, None)]
    return rows, spark.createDataFrame(rows, "contract string, tenure int, churn_flag int")


def test_kaplan_meier_equals_the_definition(lives):
    rows, df = lives
    got = {(r.contract, r.tenure): r for r in survival.kaplan_meier(df, "contract").collect()}
    known = [r for r in rows if None not in r]
    assert len(got) == len({r[:2] for r in known})
    for g in {r[0] for r in known}:
        for t, (n, s, se) in _curve([r[1:] for r in known if r[0] == g]).items():
            r = got[g, t]
            assert r.at_risk == n and r.survival == pytest.approx(s, abs=1e-6) and r.std_error == pytest.approx(se, abs=1e-6)
            assert 0 <= r.lower_95 <= r.survival <= r.upper_95 <= 1


def test_log_rank_equals_the_definition(lives):
    rows, df = lives
    got = {(r.group_a, r.group_b): r for r in survival.log_rank(df, "contract").collect()}
    known = [r for r in rows if None not in r]
    names = sorted({r[0] for r in known})
    assert set(got) == {(x, y) for i, x in enumerate(names) for y in names[i + 1 :]}
    for (x, y), r in got.items():
        o = e = v = 0.0
        for t in {u for _, u, _ in known}:
            na, nb = (sum(g == w and u >= t for g, u, _ in known) for w in (x, y))
            da, db = (sum(g == w and u == t and c for g, u, c in known) for w in (x, y))
            n, d = na + nb, da + db
            o += da
            if n:
                e += d * na / n
            if n > 1:
                v += d * na / n * nb / n * (n - d) / (n - 1)
        assert r.observed_a == o and r.expected_a == pytest.approx(e, abs=1e-6)
        if v:
            chi = (o - e) ** 2 / v
            assert r.chi_square == pytest.approx(chi, abs=2e-6) and r.p_value == pytest.approx(math.erfc(math.sqrt(chi / 2)), abs=2e-6)
        else:
            assert r.chi_square is None and r.p_value is None


def test_empty_lives(spark):
    empty = spark.createDataFrame([], "contract string, tenure int, churn_flag int")
    assert survival.kaplan_meier(empty, "contract").collect() == [] and survival.log_rank(empty, "contract").collect() == []
    assert survival.life_table(empty.withColumn("x", F.lit(1)), "contract").count() == 0
