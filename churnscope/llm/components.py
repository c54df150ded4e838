"""Connected components of a large graph by alternating stars.

Each round hangs every vertex's larger neighbours, then its smaller ones, on
the smallest vertex around (large-star and small-star); edges never multiply,
and the number of rounds is logarithmic in practice.  A round is joins and
partial aggregations; its edges are written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u, v: long) but the roots; the
    root is the smallest vertex of the component."""
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    last = None
    while True:
        print_ = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if last == tuple(print_):
            return now.select("u", F.col("v").alias("root"))
        last = tuple(print_)
        now = stored(_small_star(_large_star(now)), "edges")
