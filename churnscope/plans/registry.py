"""Query registry: name -> DataFrame builder and name -> oracle SQL.

Operator modules declare their queries with ``@query(name, sql=...)``.  The
builder receives ``Frames`` and returns a lazy DataFrame; ``sql`` is the
``SELECT`` that follows the oracle's shared ``WITH`` chain (``None`` for a
query with no SQL form; its docstring says why).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from churnscope.plans.frames import Frames
from churnscope.plans.oracle_base import with_chain


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[Frames], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


_REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, sql: str | None, ids: tuple[str, ...] = ()):
    def deco(fn: Callable[[Frames], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        _REGISTRY[name] = QuerySpec(name, fn, sql, ids)
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules registers their queries.
    from churnscope.plans import catalog  # noqa: F401


def specs() -> dict[str, QuerySpec]:
    _load_all()
    return dict(_REGISTRY)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name, spec in specs().items():
        out[name] = (lambda s: (lambda spark, sf_dir: s.build(Frames(spark, sf_dir))))(spec)
    return out


def oracle_queries() -> dict[str, str]:
    return {name: with_chain(spec.sql) for name, spec in specs().items() if spec.sql}
