"""Co-moment blocks: all pairwise moments of a set of columns in one pass.

A block holds, for every column pair, the number of rows in which both values
are present, both means, the three centred second moments, and both ranges.
Each task turns its rows into one block: Arrow batches become matrices, a batch's
sums and products about the batch means are matrix products, and blocks are
joined by the pairwise update of means and centred moments (Chan et al.), which
does not cancel digits as raw power sums do.  So a task sends one row, however
many rows and pairs there are, and the blocks of the tasks are joined by the same
update as a column expression.

NULL and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOMENTS = ["n", "mx", "my", "cxy", "cxx", "cyy", "lox", "hix", "loy", "hiy"]
BLOCK_TYPE = "struct<" + ", ".join(f"{m}: array<double>" for m in _MOMENTS) + ">"
_ARROW = pa.struct([(m, pa.list_(pa.float64())) for m in _MOMENTS])


class Block:
    """Moments of all pairs of ``k`` columns; entry [a, b] describes column a
    over the rows that have a and b."""

    def __init__(self, k: int):
        self.n, self.mean, self.var, self.co = (np.zeros((k, k)) for _ in range(4))
        self.low, self.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)

    def add(self, x: np.ndarray) -> None:
        """Rows of ``x``; NaN is missing."""
        if not len(x):
            return
        new, there = Block(x.shape[1]), ~np.isnan(x)
        seen = there.astype(float)
        centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1.0)
        off = np.where(there, x - centre, 0.0)
        new.n = seen.T @ seen
        size = np.maximum(new.n, 1.0)
        total = off.T @ seen
        new.mean = np.where(new.n > 0, centre[:, None] + total / size, 0.0)
        new.var = (off * off).T @ seen - total * total / size
        new.co = off.T @ off - total * total.T / size
        for b in range(x.shape[1]):
            rows = x if there[:, b].all() else x[there[:, b]]
            have = there if rows is x else there[there[:, b]]
            new.low[:, b] = np.where(have, rows, np.inf).min(axis=0, initial=np.inf)
            new.high[:, b] = np.where(have, rows, -np.inf).max(axis=0, initial=-np.inf)
        self.join(new)

    def join(self, other: Block) -> None:
        n = self.n + other.n
        size = np.maximum(n, 1.0)
        delta, weight = other.mean - self.mean, self.n * other.n / size
        self.co = self.co + other.co + delta * delta.T * weight
        self.var = self.var + other.var + delta * delta * weight
        self.mean = self.mean + delta * other.n / size
        self.n = n
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)

    def of_pairs(self, a: list[int], b: list[int]) -> dict[str, list[float]]:
        values = (self.n[a, b], self.mean[a, b], self.mean[b, a], self.co[a, b], self.var[a, b], self.var[b, a],
                  self.low[a, b], self.high[a, b], self.low[b, a], self.high[b, a])
        return {m: v.tolist() for m, v in zip(_MOMENTS, values)}


def _indexes(cols: list[str], pairs: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    place = {c: i for i, c in enumerate(cols)}
    return [place[a] for a, _ in pairs], [place[b] for _, b in pairs]


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1).astype(float)


def blocks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row per task: ``block``, the moments of its rows per pair."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    a, b = _indexes(cols, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_rows = Block(len(cols)), False
        for batch in batches:
            own.add(_matrix(batch, cols))
            any_rows = any_rows or batch.num_rows > 0
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([own.of_pairs(a, b)], _ARROW)], ["block"])

    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, f"block {BLOCK_TYPE}")


def with_blocks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The rows of ``df`` with ``block`` NULL, and behind those of each task one
    row that is NULL but for ``block``: the moments ride along with whatever
    else one scan of the rows is for.  Columns of the pairs must be doubles."""
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    a, b = _indexes(cols, pairs)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = Block(len(cols)), None
        for batch in batches:
            schema = batch.schema
            own.add(_matrix(batch, cols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, _ARROW)], [*names, "block"])
        if schema is not None:
            last = [pa.nulls(1, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*last, pa.array([own.of_pairs(a, b)], _ARROW)], [*names, "block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, block {BLOCK_TYPE}")


def joined(parts: Column) -> Column:
    """The moments of one pair over all its ``parts`` (an array of structs)."""
    zero = F.struct(*[F.lit(x).alias(m) for m, x in zip(_MOMENTS, [0.0] * 6 + [float("inf"), float("-inf")] * 2)])

    def update(s: Column, t: Column) -> Column:
        n = s.n + t.n
        dx, dy, weight = t.mx - s.mx, t.my - s.my, s.n * t.n / n
        return F.struct(
            n.alias("n"), (s.mx + dx * t.n / n).alias("mx"), (s.my + dy * t.n / n).alias("my"),
            (s.cxy + t.cxy + dx * dy * weight).alias("cxy"), (s.cxx + t.cxx + dx * dx * weight).alias("cxx"),
            (s.cyy + t.cyy + dy * dy * weight).alias("cyy"), F.least(s.lox, t.lox).alias("lox"), F.greatest(s.hix, t.hix).alias("hix"),
            F.least(s.loy, t.loy).alias("loy"), F.greatest(s.hiy, t.hiy).alias("hiy"),
        )

    return F.aggregate(F.filter(parts, lambda t: t.n > 0), zero, update)


def pair_moments(found: DataFrame) -> DataFrame:
    """(p, moments) per pair number from rows with a ``block``: one entry per
    task and pair is shuffled."""
    zipped = F.arrays_zip(*[F.col(f"block.{m}").alias(m) for m in _MOMENTS])
    rows = found.select(F.posexplode(zipped).alias("p", "part"))
    return rows.groupBy("p").agg(joined(F.collect_list("part")).alias("moments"))


def correlation(moments: Column) -> Column:
    """Sample Pearson r; NULL if there are no rows or a column is constant."""
    varies = (moments.n > 1) & (moments.lox < moments.hix) & (moments.loy < moments.hiy)
    return F.when(varies, F.try_divide(moments.cxy, F.sqrt(moments.cxx) * F.sqrt(moments.cyy)))
