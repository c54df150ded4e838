"""Lazy access to the base frames of one data folder.

``Frames(spark, sf_dir)`` hands out the raw accounts and the frames derived
from them.  Each property returns a lazy plan over the same sources, so Catalyst
sees the whole query and prunes what it does not need; only the order statistics
that features and quintiles need (``selection``) are found when a plan is built,
once per folder, and are constants in it.

A materialised accounts table can stand in for the derivation (as the
analysed project loads its account table once and runs every report on
it): ``register_accounts_table`` records a Parquet path for a data folder,
and ``Frames.raw`` then reads that table instead of re-deriving it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from churnscope.functions.schemas import RAW_SCHEMA
from churnscope.operators.cleaning import build_accounts, clean
from churnscope.operators.features import engineer_features
from churnscope.operators.scoring import build_scores, score_accounts
from churnscope.session import session_key
from churnscope.sources.accounts import raw_accounts

_MATERIALISED: dict[tuple[str, str], str] = {}
# Lazy plans (not data) already built for a session and folder: building a
# plan runs Spark's analyzer, which costs far more than reusing the object.
_PLANS: dict[tuple[str, str, str | None, str], DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return (session_key(spark), sf_dir.rstrip("/"))


def register_accounts_table(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Use the raw accounts stored at ``path`` (Parquet, or a CSV export when
    the path ends in ``.csv``) for every frame of ``sf_dir``."""
    _MATERIALISED[_key(spark, sf_dir)] = path


def forget_accounts_table(spark: SparkSession, sf_dir: str) -> None:
    _MATERIALISED.pop(_key(spark, sf_dir), None)


def _memo(fr: "Frames", name: str, build) -> DataFrame:
    key = (*_key(fr.spark, fr.sf_dir), _MATERIALISED.get(_key(fr.spark, fr.sf_dir)), name)
    df = _PLANS.get(key)
    if df is None:
        df = build()
        _PLANS[key] = df
    return df


@dataclass
class Frames:
    spark: SparkSession
    sf_dir: str

    def _raw(self) -> DataFrame:
        path = _MATERIALISED.get(_key(self.spark, self.sf_dir))
        if path and path.rstrip("/").lower().endswith(".csv"):
            from churnscope.sources.io import read_raw_csv

            return read_raw_csv(self.spark, path)
        if path:
            return self.spark.read.schema(RAW_SCHEMA).parquet(path)
        return raw_accounts(self.spark, self.sf_dir)

    @property
    def raw(self) -> DataFrame:
        return _memo(self, "raw", self._raw)

    @property
    def acct(self) -> DataFrame:
        """Typed accounts table (SQL semantics)."""
        return _memo(self, "acct", lambda: build_accounts(self.raw))

    @property
    def clean(self) -> DataFrame:
        """Cleaned analysis frame (notebook semantics)."""
        return _memo(self, "clean", lambda: clean(self.raw))

    @property
    def feat(self) -> DataFrame:
        """Feature frame: cleaned frame plus 22 features."""
        return _memo(self, "feat", lambda: engineer_features(self.clean))

    @property
    def scored(self) -> DataFrame:
        """Scores and tiers without the quintile columns."""
        return _memo(self, "scored", lambda: score_accounts(self.acct))

    def scored_full(self) -> DataFrame:
        """The full scored table with the three quintile columns."""
        return build_scores(self.acct)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
