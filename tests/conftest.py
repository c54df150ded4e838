from __future__ import annotations

import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from churnscope.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=4, app_name="churnscope-tests")
    yield s
    s.stop()


def raw_row(
    cid="A1",
    gender="Male",
    senior=0,
    partner="Yes",
    dependents="No",
    tenure=10,
    phone="Yes",
    lines="No",
    internet="DSL",
    services=("No", "No", "No", "No", "No", "No"),
    contract="Month-to-month",
    paperless="Yes",
    payment="Electronic check",
    monthly="50.00",
    total="500.00",
    churn="No",
):
    return (
        cid,
        gender,
        senior,
        partner,
        dependents,
        tenure,
        phone,
        lines,
        internet,
        *services,
        contract,
        paperless,
        payment,
        None if monthly is None else Decimal(monthly),
        total,
        churn,
    )


@pytest.fixture
def make_raw(spark):
    from churnscope.functions.schemas import RAW_SCHEMA

    def build(rows):
        return spark.createDataFrame(rows, RAW_SCHEMA)

    return build


def plan_text(df) -> str:
    """The formatted physical plan (full PushedFilters / ReadSchema lists)."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)
