"""All chart data in one query (CH10): one scan, one long table."""

from __future__ import annotations

from churnscope.functions.numeric import pct_sql
from churnscope.plans.catalog.stats_queries import _box_sql, _corr_matrix_sql, _hist_sql, _kde_sql
from churnscope.plans.charts import chart_table
from churnscope.plans.registry import query

_KINDS = {"series": "VARCHAR", "label": "VARCHAR", "x": "DOUBLE", "n": "BIGINT", "churned": "BIGINT", "value": "DOUBLE"}
_RATE = {"n": "COUNT(*)", "churned": "SUM(churn_flag)", "value": pct_sql("SUM(churn_flag)", "COUNT(*)", 1)}


def _rows(chart: str, source: str, **columns: str) -> str:
    shown = ", ".join(f"CAST({columns.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in _KINDS.items())
    return f"SELECT '{chart}' AS chart, {shown} FROM {source}"


def _segment(chart: str, key: str, series: str | None = None) -> str:
    keys = [k for k in (series, key) if k]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return _rows(chart, "feat", label=key, **({"series": series} if series else {}), **_RATE) + f" WHERE {known} GROUP BY {', '.join(keys)}"


def _chart_sql() -> str:
    figures = ["min", "q1", "median", "q3", "max", "iqr", "lower_whisker", "upper_whisker"]
    return " UNION ALL ".join(
        [
            _rows("overview", "feat", **_RATE),
            _segment("contract", "contract"),
            _segment("payment", "payment_method"),
            _segment("services", "num_services"),
            _segment("heatmap", "internet_service", "contract"),
            _rows("tenure_density", f"({_kde_sql('tenure', 0, 75)}) k", series="churn_flag", x="x", value="density"),
            _rows("charges_density", f"({_kde_sql('monthly_charges', None, None)}) k", series="churn_flag", x="x", value="density"),
            *[_rows("charges_box", f"({_box_sql()}) b", series="churn_flag", label=f"'{f}'", n="n", value=f'"{f}"') for f in figures],
            _rows("health_hist", f"({_hist_sql()}) h", series="churn_flag", label="bin", x="bin_start", n='"count"', value="bin_end"),
            _rows("correlation", f"({_corr_matrix_sql()}) c", series="feature_a", label="feature_b", value="pearson_r"),
        ]
    )


@query("chart_data_all", _chart_sql(), ("CH10",))
def chart_data_all(fr):
    """Every chart's numbers in long form, from one scan of the accounts."""
    return chart_table(fr.feat)
