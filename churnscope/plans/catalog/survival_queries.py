"""Survival of accounts by contract (CO03): curves and log-rank tests."""

from __future__ import annotations

from churnscope.functions.numeric import round_to_sql
from churnscope.operators import stats, survival
from churnscope.plans.registry import query

_HIST = (
    "SELECT contract, tenure, CAST(SUM(churn_flag) AS BIGINT) AS events, CAST(SUM(1 - churn_flag) AS BIGINT) AS censored "
    "FROM customers WHERE contract IS NOT NULL AND tenure IS NOT NULL AND churn_flag IS NOT NULL GROUP BY contract, tenure"
)
_LIFE = (
    "SELECT *, CAST(SUM(events + censored) OVER (PARTITION BY contract ORDER BY tenure DESC "
    f"ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM ({_HIST}) h"
)
_Z = repr(survival.Z95)


def _curve_sql() -> str:
    so_far = "OVER (PARTITION BY contract ORDER BY tenure ROWS UNBOUNDED PRECEDING)"
    n, d = "CAST(at_risk AS DOUBLE)", "CAST(events AS DOUBLE)"
    steps = (
        f"SELECT *, MAX(CASE WHEN events = at_risk THEN 1 ELSE 0 END) {so_far} AS ended, "
        f"SUM(CASE WHEN events < at_risk THEN LN(1 - {d} / {n}) ELSE 0.0 END) {so_far} AS log_left, "
        f"SUM(CASE WHEN events < at_risk THEN {d} / ({n} * ({n} - {d})) ELSE 0.0 END) {so_far} AS spread FROM ({_LIFE}) l"
    )
    values = f"SELECT *, CASE WHEN ended = 1 THEN 0.0 ELSE EXP(log_left) END AS s, CASE WHEN ended = 1 THEN 0.0 ELSE EXP(log_left) * SQRT(spread) END AS se FROM ({steps}) x"
    return (
        f"SELECT contract, tenure, at_risk, events, censored, {round_to_sql('s', 6)} AS survival, {round_to_sql('se', 6)} AS std_error, "
        f"{round_to_sql(f'GREATEST(s - {_Z} * se, 0.0)', 6)} AS lower_95, {round_to_sql(f'LEAST(s + {_Z} * se, 1.0)', 6)} AS upper_95 FROM ({values}) v"
    )


@query("survival_curve", _curve_sql(), ("CO03",))
def survival_curve(fr):
    """Kaplan-Meier survival of accounts per contract and month of tenure."""
    return survival.kaplan_meier(fr.acct, "contract")


def _log_rank_sql() -> str:
    # Without windows: what is at risk at a time are the accounts seen that long.
    side = (
        "SELECT g.contract, t.tenure AS t, CAST(COALESCE(SUM(h.events) FILTER (h.tenure = t.tenure), 0) AS DOUBLE) AS d, "
        "CAST(COALESCE(SUM(h.events + h.censored) FILTER (h.tenure >= t.tenure), 0) AS DOUBLE) AS n "
        f"FROM (SELECT DISTINCT contract FROM ({_HIST}) h1) g CROSS JOIN (SELECT DISTINCT tenure FROM ({_HIST}) h2) t "
        f"JOIN ({_HIST}) h ON h.contract = g.contract GROUP BY g.contract, t.tenure"
    )
    sums = (
        "SELECT a.contract AS group_a, b.contract AS group_b, SUM(a.d) AS o, "
        "SUM(COALESCE((a.d + b.d) * a.n / NULLIF(a.n + b.n, 0), 0)) AS e, "
        "SUM(COALESCE((a.d + b.d) * a.n / NULLIF(a.n + b.n, 0) * (b.n / NULLIF(a.n + b.n, 0)) "
        "* (a.n + b.n - a.d - b.d) / NULLIF(a.n + b.n - 1, 0), 0)) AS v "
        f"FROM ({side}) a JOIN ({side}) b ON a.t = b.t AND a.contract < b.contract GROUP BY 1, 2"
    )
    chi = "(o - e) * (o - e) / CASE WHEN v > 0 THEN v END"
    p = f"CASE WHEN chi IS NOT NULL THEN LEAST({stats.erfc_sql('SQRT(chi / 2.0)')}, 1.0) END"
    return (
        f"SELECT group_a, group_b, CAST(o AS BIGINT) AS observed_a, {round_to_sql('e', 6)} AS expected_a, "
        f"{round_to_sql('chi', 6)} AS chi_square, {round_to_sql(p, 6)} AS p_value FROM (SELECT *, {chi} AS chi FROM ({sums}) s) c"
    )


@query("logrank_contract", _log_rank_sql(), ("CO03", "ST01"))
def logrank_contract(fr):
    """Log-rank test of the survival of every two contracts."""
    return survival.log_rank(fr.acct, "contract")
