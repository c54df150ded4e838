"""Feature engineering (FE01-FE24) and the 1-decimal health score.

Every feature is a column expression over one row, except two global
scalars (maximum tenure and the 75th percentile of monthly charges).  Those
are constants that ``selection`` finds when the features are built, from sketches
and exact counts around the wanted rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.functions.numeric import ratio, round_to
from churnscope.functions.schemas import (
    AUTOPAY_METHODS,
    AUTOPAY_POINTS,
    CONTRACT_ORDINAL,
    CONTRACT_POINTS,
    FLAG_COLS,
    INTERNET_FIBER,
    INTERNET_NONE,
    MAX_RAW_POINTS,
    PAY_ECHECK,
    POINTS_PER_SERVICE,
    SECURITY_COLS,
    SERVICE_COLS,
    SERVICE_DEPTH,
    STREAMING_COLS,
    TECH_SUPPORT_POINTS,
    TENURE_BANDS,
    TENURE_LABELS_PY,
    TENURE_POINTS,
    TIER_AT_RISK,
    TIER_HEALTHY,
    TIER_NEEDS,
)
from churnscope.operators.selection import quantile_values


def _is_yes(c: str) -> Column:
    # NULL == 'Yes' counts as not-Yes (pandas compares NaN as False).
    return F.coalesce(F.col(c) == "Yes", F.lit(False))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("int")


def _band(c: Column, bands: list[tuple[int, int]], values: list) -> Column:
    """Right-closed integer bands; values outside every band give NULL."""
    expr = None
    for (lo, hi), value in zip(bands, values):
        cond = (c >= lo) & (c <= hi)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr


def _map(c: Column, mapping: dict) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == key, value) if expr is None else expr.when(c == key, value)
    return expr


def tenure_points(c: Column) -> Column:
    return _band(c, TENURE_BANDS, TENURE_POINTS)


def contract_points(c: Column) -> Column:
    return _map(c, CONTRACT_POINTS)


def global_scalars(df: DataFrame) -> dict[str, Column]:
    """The two global scalars of the feature pipeline as constants: maximum
    tenure and the exact 75th percentile of monthly charges (6 dp); NULL for an
    empty frame."""
    found = quantile_values(df, ["tenure", "monthly_charges"], [0.75, 1.0])
    at = lambda name, p: F.lit(found.get((0, name, p))).cast("double")
    return {"max_tenure": at("tenure", 1.0).cast("int"), "p75": round_to(at("monthly_charges", 0.75), 6)}


def add_tenure_features(df: DataFrame, scalars: dict[str, Column] | None = None) -> DataFrame:
    """FE01-FE03."""
    scalars = scalars if scalars is not None else global_scalars(df)
    max_tenure = scalars["max_tenure"]
    return df.withColumns(
        {
            "tenure_bucket": _band(F.col("tenure"), TENURE_BANDS, TENURE_LABELS_PY),
            "is_new_customer": _flag(F.col("tenure") < 6),
            "tenure_normalized": ratio(F.col("tenure"), max_tenure),
        }
    )


def add_service_features(df: DataFrame) -> DataFrame:
    """FE04-FE07."""
    num = reduce(lambda a, b: a + b, [_flag(_is_yes(c)) for c in SERVICE_COLS]).cast("int")
    any_security = reduce(lambda a, b: a | b, [_is_yes(c) for c in SECURITY_COLS])
    any_streaming = reduce(lambda a, b: a | b, [_is_yes(c) for c in STREAMING_COLS])
    depth = None
    for lo, hi, label in SERVICE_DEPTH:
        cond = (F.col("num_services") >= lo) & (F.col("num_services") <= hi)
        depth = F.when(cond, label) if depth is None else depth.when(cond, label)
    return df.withColumns(
        {
            "num_services": num,
            "has_any_security": _flag(any_security),
            "is_streaming_only": _flag(any_streaming & ~any_security),
        }
    ).withColumn("service_depth", depth)


def add_billing_features(df: DataFrame, scalars: dict[str, Column] | None = None) -> DataFrame:
    """FE08-FE12.  The high-spender cut is the exact 75th percentile
    (linear interpolation), rounded to 6 places so that an interpolation
    rounding error can never flip ``>=`` for a value equal to it."""
    scalars = scalars if scalars is not None else global_scalars(df)
    p75 = scalars["p75"]
    monthly = F.col("monthly_charges")
    tenure = F.col("tenure")
    expected = monthly * F.greatest(tenure, F.lit(1))
    consistency = F.when(tenure.isNotNull(), round_to(ratio(F.col("total_charges"), expected), 3))
    return df.withColumns(
        {
            "charge_per_service": monthly / (F.col("num_services") + 1),
            "charge_consistency_ratio": consistency,
            "is_high_spender": _flag(monthly >= p75),
            "is_autopay": _flag(F.col("payment_method").isin(AUTOPAY_METHODS)),
            "is_electronic_check": _flag(F.col("payment_method") == PAY_ECHECK),
        }
    )


def encode_boolean_cols(df: DataFrame) -> DataFrame:
    """FE13-FE20."""
    flags = {f"{c}_flag": _flag(_is_yes(c)) for c in FLAG_COLS if c in df.columns}
    internet = F.col("internet_service")
    flags.update(
        {
            "contract_ordinal": _map(F.col("contract"), CONTRACT_ORDINAL).cast("int"),
            # pandas: NaN != 'No' is True, so a missing service counts as internet.
            "has_internet": _flag(F.coalesce(internet != INTERNET_NONE, F.lit(True))),
            "has_fiber": _flag(internet == INTERNET_FIBER),
        }
    )
    return df.withColumns(flags)


def health_points(df: DataFrame) -> Column:
    """Raw health points (max 105); NULL when tenure or contract is unknown."""
    return (
        tenure_points(F.col("tenure"))
        + contract_points(F.col("contract"))
        + F.col("num_services") * POINTS_PER_SERVICE
        + F.col("is_autopay") * AUTOPAY_POINTS
        + _flag(_is_yes("tech_support")) * TECH_SUPPORT_POINTS
    )


def compute_health_score(df: DataFrame) -> DataFrame:
    """FE21-FE22: points / 105 * 100, clipped to 0..100, 1 decimal; tier by
    right-closed bands (-1,39], (39,69], (69,100]."""
    raw = health_points(df)
    scaled = raw.cast("double") / MAX_RAW_POINTS * 100.0
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0))
    score = F.when(raw.isNotNull(), round_to(clipped, 1))
    # The score is clipped to 0..100 (or NULL), so the bands' lower bounds are
    # implied and each band needs one comparison: fewer copies of the score
    # expression when a filter on the tier is pushed down to the scan.
    s = F.col("health_score")
    tier = F.when(s <= 39, TIER_AT_RISK).when(s <= 69, TIER_NEEDS).when(s <= 100, TIER_HEALTHY)
    return df.withColumn("health_score", score).withColumn("health_tier", tier)


def engineer_features(clean_df: DataFrame) -> DataFrame:
    """FE23: the whole feature pipeline on the cleaned frame (44 columns)."""
    scalars = global_scalars(clean_df)
    return (
        clean_df.transform(add_tenure_features, scalars)
        .transform(add_service_features)
        .transform(add_billing_features, scalars)
        .transform(encode_boolean_cols)
        .transform(compute_health_score)
    )
