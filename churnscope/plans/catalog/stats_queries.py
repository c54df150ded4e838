"""Named statistics (ST), chart-data (CH03, CH04, CH06) and feature-summary
(FE24) queries with their oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from churnscope.functions.numeric import mean_sql, round_fine_sql, round_to_sql
from churnscope.functions.schemas import CORR_FEATURES, SUMMARY_CATEGORICAL, SUMMARY_FEATURES
from churnscope.operators import distributions, stats
from churnscope.plans.registry import query

SQRT2 = repr(math.sqrt(2.0))
SQRT_2PI = repr(math.sqrt(2.0 * math.pi))


def _mw_sql(value: str, group_cond: str, frame: str) -> str:
    hist = (
        f"SELECT {value} AS v, SUM(CASE WHEN {group_cond} THEN 1 ELSE 0 END) AS n1, "
        f"SUM(CASE WHEN {group_cond} THEN 0 ELSE 1 END) AS n2 FROM {frame} "
        f"WHERE {value} IS NOT NULL AND ({group_cond}) IS NOT NULL GROUP BY {value}"
    )
    ranked = (
        "SELECT n1, n2, n1 + n2 AS c, "
        "CAST(COALESCE(SUM(n1 + n2) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)"
        f" + (CAST(n1 + n2 AS DOUBLE) + 1.0) / 2.0 AS avg_rank FROM ({hist}) h"
    )
    s = (
        "SELECT SUM(CAST(n1 AS DOUBLE) * avg_rank) AS r1, CAST(SUM(n1) AS DOUBLE) AS n1, "
        "CAST(SUM(n2) AS DOUBLE) AS n2, SUM(POW(CAST(c AS DOUBLE), 3) - CAST(c AS DOUBLE)) AS tie "
        f"FROM ({ranked}) r"
    )
    u = (
        "SELECT n1, n2, r1 - n1 * (n1 + 1.0) / 2.0 AS u1, "
        "n1 * n2 - (r1 - n1 * (n1 + 1.0) / 2.0) AS u2, n1 * n2 / 2.0 AS mu, "
        "n1 * n2 / 12.0 * ((n1 + n2 + 1.0) - tie / NULLIF((n1 + n2) * (n1 + n2 - 1.0), 0)) AS var "
        f"FROM ({s}) s"
    )
    z = (
        "SELECT n1, n2, u1, (GREATEST(u1, u2) - mu - 0.5) / NULLIF(CASE WHEN var > 0 THEN sqrt(var) END, 0) AS z "
        f"FROM ({u}) u"
    )
    p_expr = f"CASE WHEN z IS NOT NULL THEN LEAST({stats.erfc_sql(f'z / {SQRT2}')}, 1.0) END"
    log_p = f"CASE WHEN z IS NOT NULL THEN LEAST({stats.log10_erfc_sql(f'GREATEST(z, 0.0) / {SQRT2}')}, 0.0) END"
    ok = "n1 > 0 AND n2 > 0"
    return (
        "SELECT n1, n2, u_statistic, z_score, p_value, log10_p_value, p_value < 0.05 AS significant, "
        f"{round_to_sql('u_statistic / NULLIF(CAST(n1 * n2 AS DOUBLE), 0)', 6)} AS auc FROM ("
        "SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, "
        f"CASE WHEN {ok} THEN u1 END AS u_statistic, "
        f"CASE WHEN {ok} THEN {round_to_sql('z', 6)} END AS z_score, "
        f"CASE WHEN {ok} THEN {round_to_sql(p_expr, 6)} END AS p_value, "
        f"CASE WHEN {ok} THEN {round_to_sql(log_p, 6)} END AS log10_p_value "
        f"FROM ({z}) z) t"
    )


@query("mannwhitney_tenure", _mw_sql("tenure", "churn_flag = 1", "feat"), ("ST01",))
def mannwhitney_tenure(fr):
    """Tenure of churned vs retained accounts (two-sided U test)."""
    return stats.mann_whitney(fr.feat, "tenure", F.col("churn_flag") == 1)


_SMALL_BY = "contract, internet_service, payment_method, num_services"


def _exact_sql() -> str:
    """The rank-sum distribution by a recursion over tie blocks."""
    least, most = stats.EXACT_SMALLER, stats.EXACT_ROWS
    hist = (
        f"SELECT {_SMALL_BY}, tenure AS v, CAST(SUM(churn_flag) AS BIGINT) AS n1, CAST(SUM(1 - churn_flag) AS BIGINT) AS n2 "
        f"FROM feat WHERE tenure IS NOT NULL AND churn_flag IS NOT NULL GROUP BY {_SMALL_BY}, tenure"
    )
    seg = (
        f"SELECT {_SMALL_BY}, CAST(SUM(n1) AS BIGINT) AS t1, CAST(SUM(n2) AS BIGINT) AS t2, LEAST(SUM(n1), SUM(n2)) AS k, COUNT(*) AS nb, "
        f"ROW_NUMBER() OVER () AS seg FROM h GROUP BY {_SMALL_BY} HAVING LEAST(SUM(n1), SUM(n2)) BETWEEN 1 AND {least} AND SUM(n1) + SUM(n2) <= {most}"
    )
    same = " AND ".join(f"h.{c} IS NOT DISTINCT FROM g.{c}" for c in _SMALL_BY.split(", "))
    block = (
        "SELECT g.seg, g.k, h.n1, h.n2, h.n1 + h.n2 AS c, ROW_NUMBER() OVER w AS rn, "
        "CAST(2 * SUM(h.n1 + h.n2) OVER w - (h.n1 + h.n2) + 1 AS BIGINT) AS r2, "
        f"SUM(h.n2) OVER w - h.n2 / 2.0 AS below FROM g JOIN h ON {same} WINDOW w AS (PARTITION BY g.seg ORDER BY h.v ROWS UNBOUNDED PRECEDING)"
    )
    ways = "list_product(list_transform(range(1, t.t + 1), lambda i: (b.c - t.t + i) / CAST(i AS DOUBLE)))"
    step = (
        f"SELECT b.seg, b.rn, d.j + t.t AS j, d.s + t.t * b.r2 AS s, SUM(d.w * CASE WHEN t.t = 0 THEN 1.0 ELSE {ways} END) AS w "
        f"FROM dp d JOIN b ON b.seg = d.seg AND b.rn = d.rn + 1 JOIN range(0, {least + 1}) t(t) ON t.t <= b.c AND d.j + t.t <= b.k GROUP BY 1, 2, 3, 4"
    )
    seen = (
        "SELECT g.*, SUM(b.n1 * b.below) AS u, SUM((CASE WHEN g.t1 <= g.t2 THEN b.n1 ELSE b.n2 END) * b.r2) AS s0 "
        "FROM g JOIN b ON b.seg = g.seg GROUP BY ALL"
    )
    p = "SUM(d.w) FILTER (ABS(d.s - x.k * (x.t1 + x.t2 + 1)) >= ABS(x.s0 - x.k * (x.t1 + x.t2 + 1))) / SUM(d.w)"
    last = (
        f"SELECT {_SMALL_BY}, x.t1 AS n1, x.t2 AS n2, CAST(x.u AS DOUBLE) AS u_statistic, {round_to_sql(p, 6)} AS p_value "
        f"FROM ({seen}) x JOIN dp d ON d.seg = x.seg AND d.rn = x.nb AND d.j = x.k GROUP BY {_SMALL_BY}, x.t1, x.t2, x.u, x.k, x.s0"
    )
    return (
        f"SELECT *, p_value < 0.05 AS significant FROM (WITH RECURSIVE h AS MATERIALIZED ({hist}), g AS MATERIALIZED ({seg}), b AS MATERIALIZED ({block}), "
        f"dp(seg, rn, j, s, w) AS (SELECT seg, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM g UNION ALL {step}) {last}) q"
    )


@query("mannwhitney_small_segments", _exact_sql(), ("ST01",))
def mannwhitney_small_segments(fr):
    """Tenure of churned vs retained accounts in every segment too small for
    the normal form: exact permutation test."""
    return stats.mann_whitney_exact(fr.feat, _SMALL_BY.split(", "), "tenure", F.col("churn_flag") == 1)


@query("mannwhitney_health_score", _mw_sql("health_score", "churn_flag = 1", "feat"), ("ST01", "7.6"))
def mannwhitney_health_score(fr):
    """Health score of churned vs retained accounts; U / (n1 n2) is the AUC
    of the score as a churn classifier (lower score, higher risk)."""
    return stats.mann_whitney(fr.feat, "health_score", F.col("churn_flag") == 1)


def _pearson_sql(a: str, b: str) -> str:
    # Pairwise-complete observations: both values present.
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return round_to_sql(
        f"COVAR_SAMP({x}, {y}) / NULLIF(STDDEV_SAMP({x}) * STDDEV_SAMP({y}), 0)", 6
    )


def _corr_with_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_pearson_sql(c, 'churn_flag')} AS pearson_r FROM feat" for c in CORR_FEATURES
    )
    return (
        "SELECT feature, pearson_r, CASE WHEN pearson_r < 0 THEN 'negative' "
        f"WHEN pearson_r >= 0 THEN 'positive' END AS direction FROM ({rows}) r"
    )


@query("corr_with_churn", _corr_with_sql(), ("ST02",))
def corr_with_churn(fr):
    return stats.corr_with(fr.feat, CORR_FEATURES, "churn_flag")


MATRIX_COLS = CORR_FEATURES + ["churn_flag"]


def _corr_matrix_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(MATRIX_COLS) for b in MATRIX_COLS[:i]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_pearson_sql(a, b)} AS pearson_r FROM feat"
        for a, b in pairs
    )


@query("corr_matrix", _corr_matrix_sql(), ("ST03", "CH09"))
def corr_matrix(fr):
    return stats.corr_matrix(fr.feat, MATRIX_COLS)


def _kde_sql(value: str, start: int | None, stop: int | None) -> str:
    base = f"SELECT churn_flag, CAST({value} AS DOUBLE) AS v FROM feat WHERE {value} IS NOT NULL AND churn_flag IS NOT NULL"
    low = "CAST(FLOOR(lo - 3 * bw) AS BIGINT)" if start is None else str(start)
    high = "CAST(CEIL(hi + 3 * bw) AS BIGINT)" if stop is None else str(stop)
    return (
        "SELECT churn_flag, CAST(x AS INTEGER) AS x, "
        f"{round_fine_sql(f'SUM(cnt * exp(-0.5 * z * z)) / NULLIF(CAST(n AS DOUBLE) * bw * {SQRT_2PI}, 0)', 10)} AS density "
        "FROM (SELECT h.churn_flag, h.cnt, st.n, st.bw, st.x, (st.x - h.v) / NULLIF(st.bw, 0) AS z FROM "
        f"(SELECT churn_flag, v, CAST(COUNT(*) AS DOUBLE) AS cnt FROM ({base}) b GROUP BY churn_flag, v) h "
        f"JOIN (SELECT churn_flag, n, bw, UNNEST(range({low}, {high} + 1)) AS x FROM ("
        "SELECT churn_flag, CAST(COUNT(*) AS BIGINT) AS n, MIN(v) AS lo, MAX(v) AS hi, "
        "COALESCE(STDDEV_SAMP(v), 0) * POW(CAST(COUNT(*) AS DOUBLE), -0.2) AS bw "
        f"FROM ({base}) b2 GROUP BY churn_flag) s0) st ON h.churn_flag = st.churn_flag"
        ") t GROUP BY churn_flag, x, n, bw"
    )


@query("chart_tenure_density", _kde_sql("tenure", 0, 75), ("CH03",))
def chart_tenure_density(fr):
    """Gaussian KDE of tenure per churn status on the grid 0..75 months."""
    return distributions.kde_on_grid(fr.feat, "churn_flag", "tenure", 0, 75)


@query("chart_charges_density", _kde_sql("monthly_charges", None, None), ("CH04",))
def chart_charges_density(fr):
    """Gaussian KDE of monthly charges per churn status, over all charges and
    three bandwidths beyond them."""
    return distributions.kde_on_grid(fr.feat, "churn_flag", "monthly_charges")


def _box_sql() -> str:
    v = "CAST(monthly_charges AS DOUBLE)"
    base = f"SELECT churn_flag, {v} AS v FROM feat WHERE monthly_charges IS NOT NULL AND churn_flag IS NOT NULL"
    q = (
        "SELECT churn_flag, CAST(COUNT(*) AS BIGINT) AS n, MIN(v) AS min, "
        f"{round_to_sql('QUANTILE_CONT(v, 0.25)', 6)} AS q1, {round_to_sql('QUANTILE_CONT(v, 0.5)', 6)} AS median, "
        f"{round_to_sql('QUANTILE_CONT(v, 0.75)', 6)} AS q3, MAX(v) AS max FROM ({base}) b GROUP BY churn_flag"
    )
    q2 = f"SELECT *, {round_to_sql('q3 - q1', 6)} AS iqr FROM ({q}) q"
    return (
        "SELECT q.*, w.lower_whisker, w.upper_whisker FROM (" + q2 + ") q JOIN ("
        "SELECT b.churn_flag, MIN(CASE WHEN b.v >= q.q1 - 1.5 * q.iqr THEN b.v END) AS lower_whisker, "
        "MAX(CASE WHEN b.v <= q.q3 + 1.5 * q.iqr THEN b.v END) AS upper_whisker "
        f"FROM ({base}) b JOIN ({q2}) q ON b.churn_flag = q.churn_flag GROUP BY b.churn_flag) w "
        "ON q.churn_flag = w.churn_flag"
    )


@query("chart_charges_box", _box_sql(), ("CH04",))
def chart_charges_box(fr):
    return distributions.box_stats(fr.feat, "churn_flag", "monthly_charges")


def _hist_sql() -> str:
    base = "SELECT churn_flag, CAST(health_score AS DOUBLE) AS v FROM feat WHERE health_score IS NOT NULL AND churn_flag IS NOT NULL"
    rng = f"SELECT churn_flag, MIN(v) AS lo, MAX(v) AS hi FROM ({base}) b GROUP BY churn_flag"
    cnt = (
        "SELECT b.churn_flag, CAST(CASE WHEN r.hi - r.lo = 0 THEN 0 "
        "ELSE LEAST(FLOOR((b.v - r.lo) * 20 / NULLIF(r.hi - r.lo, 0)), 19) END AS INTEGER) AS bin, "
        f"CAST(COUNT(*) AS BIGINT) AS c FROM ({base}) b JOIN ({rng}) r ON b.churn_flag = r.churn_flag GROUP BY 1, 2"
    )
    return (
        "SELECT r.churn_flag, CAST(g.bin AS INTEGER) AS bin, "
        f"{round_to_sql('r.lo + g.bin * (r.hi - r.lo) / 20', 6)} AS bin_start, "
        f"{round_to_sql('r.lo + (g.bin + 1) * (r.hi - r.lo) / 20', 6)} AS bin_end, "
        f"CAST(COALESCE(c.c, 0) AS BIGINT) AS count FROM ({rng}) r CROSS JOIN range(0, 20) g(bin) "
        f"LEFT JOIN ({cnt}) c ON c.churn_flag = r.churn_flag AND c.bin = g.bin"
    )


@query("chart_health_hist", _hist_sql(), ("CH06",))
def chart_health_hist(fr):
    return distributions.equal_width_histogram(fr.feat, "churn_flag", "health_score", 20)


def _summary_sql() -> str:
    parts = []
    for c in SUMMARY_FEATURES:
        if c in SUMMARY_CATEGORICAL:
            parts.append(
                f"SELECT '{c}' AS feature, CAST(SUM(cnt) AS BIGINT) AS count, CAST(COUNT(*) AS DOUBLE) AS \"unique\", "
                "FIRST(value ORDER BY cnt DESC, value ASC) AS top, CAST(MAX(cnt) AS DOUBLE) AS freq, "
                "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                "CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75, "
                "CAST(NULL AS DOUBLE) AS max FROM ("
                f"SELECT CAST({c} AS VARCHAR) AS value, COUNT(*) AS cnt FROM feat WHERE {c} IS NOT NULL GROUP BY 1) vc"
            )
        else:
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT '{c}', CAST(COUNT({x}) AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), "
                f"CAST(NULL AS DOUBLE), {round_to_sql(mean_sql(x), 6)}, {round_to_sql(f'STDDEV_SAMP({x})', 6)}, "
                f"MIN({x}), {round_to_sql(f'QUANTILE_CONT({x}, 0.25)', 6)}, {round_to_sql(f'QUANTILE_CONT({x}, 0.5)', 6)}, "
                f"{round_to_sql(f'QUANTILE_CONT({x}, 0.75)', 6)}, MAX({x}) FROM feat"
            )
    # The categorical branch names the columns, so list it first.
    parts.sort(key=lambda p: 0 if '"unique"' in p else 1)
    return " UNION ALL ".join(parts)


@query("feature_summary", _summary_sql(), ("FE24",))
def feature_summary(fr):
    return distributions.feature_summary(fr.feat, SUMMARY_FEATURES, SUMMARY_CATEGORICAL)
