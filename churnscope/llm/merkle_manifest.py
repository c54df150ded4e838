"""Merkle manifest of a dataset: leaf hashes, one tree per source, one tree over
the sources, and for every row the proof that it belongs to the root.

All trees have arity 3: while several nodes remain, every three consecutive
ones (a last run: fewer, even one) become the SHA-256 of their digests, written
as hex text one behind the other.

How a tree is climbed.  Nodes are numbered from 0 in their group.  The node of
level ``l`` stands on the row of its first leaf, so the siblings of level ``l``
are a fixed number of rows away: ``3^l`` or ``2 * 3^l``.  Per level, lag and
lead columns of those two offsets, masked by the node's slot in its run and the
length of the run, are its siblings; the row of a run's first child hashes the
parent.  Leaves are dealt out in blocks of ``3^LEVELS`` consecutive numbers,
which no run of these levels crosses: a window never holds more than one block,
a group of any size is many blocks, and all ``LEVELS`` levels take one shuffle.
The siblings of every level are then carried forward to all leaves under the
node (the last value not NULL).  The digests of the blocks are the nodes of the
next round, a 2187th of the rows; so the number of rounds is the logarithm of
the largest group to that base.  Paths go back down by (group, block), a key
that no more than one block of rows shares.

The numbers come from a range partition by (source, id, leaf): the row's place
in its partition plus the rows of its source in the partitions before, a table
with a row per source and partition.

DataFrame operations only.  Defined cases: NULL values have a mark of their own
in the leaf; a NULL source is a source, ordered first; rows with one id follow
by their leaf digest, and equal rows are separate leaves; a source of one row
has its leaf as its tree's root; a path without siblings is an empty array; an
empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.storage import stored

ARITY = 3
LEVELS = 7
BLOCK = ARITY**LEVELS
_PID_BITS = 33  # monotonically_increasing_id: partition << 33 | place


def field(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _place(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their number within the group in ``order``, and
    ``n``, the group's size.  Rows equal in ``order`` are told apart by a salt
    that has been written, so that none of them has to share a task."""
    keys = [*group, *order, "salt"]
    kept = stored(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "merkle-rows")
    tagged = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("tag", F.monotonically_increasing_id())
    tagged = stored(tagged.withColumn("pid", F.shiftright("tag", _PID_BITS)), "merkle-order")
    parts = tagged.groupBy(*group, "pid").agg(F.count(F.lit(1)).alias("rows"), F.min("tag").alias("first"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("rows").over(Window.partitionBy(*group))})
    placed = _joined(tagged, parts.drop("rows"), [*group, "pid"])
    return placed.withColumn("idx", F.col("tag") - F.col("first") + F.col("before")).drop("tag", "pid", "first", "before")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on null-safe equality; the keys come from ``left``."""
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    return met.select("a.*", *[F.col(f"b.{c}") for c in right.columns if c not in on])


def _block_levels(nodes: DataFrame, group: list[str], levels: int) -> DataFrame:
    """``nodes`` (group, idx, n, digest, ...) with ``block``, the siblings
    ``path_l`` (left, right; NULL above the group's root) of each level, and on
    the first row of a block ``up``, the digest of the block."""
    out = nodes.withColumns({"block": F.floor(F.col("idx") / BLOCK), "up": F.col("digest")})
    rows = Window.partitionBy(*group, "block").orderBy("idx")
    for level in range(levels):
        step = ARITY**level
        near = {f"{kind}{k}": f("up", k * step).over(rows) for kind, f in (("lag", F.lag), ("lead", F.lead)) for k in (1, 2)}
        number, count = F.floor(F.col("idx") / step), F.ceil(F.col("n") / step)
        slot = number % ARITY
        run = F.least(F.lit(ARITY), count - (number - slot))
        left = F.when(slot == 1, F.col("lag1")).when(slot == 2, F.concat("lag2", "lag1")).otherwise("")
        right = (
            F.when((slot == 0) & (run == 3), F.concat("lead1", "lead2"))
            .when(((slot == 0) & (run == 2)) | ((slot == 1) & (run == 3)), F.col("lead1"))
            .otherwise("")
        )
        climbs = (F.col("idx") % step == 0) & (count > 1)
        out = out.withColumns(near).withColumn(f"path_{level}", F.when(climbs, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(climbs, digest(F.col("up"), F.col(f"path_{level}.right"))).otherwise(F.col("up"))
        out = out.withColumn("up", F.when(F.col("idx") % (step * ARITY) == 0, parent)).drop(*near)
    carried = rows.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({f"path_{k}": F.last(f"path_{k}", ignorenulls=True).over(carried) for k in range(levels)})


def _climb(nodes: DataFrame, group: list[str], carry: list[str], finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``group``, ``carry``, ``path`` and what ``finish`` makes of the groups'
    roots (``group``, ``block`` 0, empty ``path``, ``top``) for every node."""
    rounds = []
    while True:
        largest = nodes.agg(F.max("n")).first()[0] or 1
        levels = next(k for k in range(LEVELS + 1) if k == LEVELS or ARITY**k >= largest)
        kept = [*group, "idx", "n", "block", "up", *[f"path_{k}" for k in range(levels)], *([] if rounds else carry)]
        nodes = stored(_block_levels(nodes, group, levels).select(*kept), "merkle-levels")
        path = F.array_compact(F.array(*[F.col(f"path_{k}") for k in range(levels)])) if levels else _no_path()
        rounds.append((nodes, path))
        if largest <= BLOCK:
            break
        nodes = nodes.where(F.col("idx") % BLOCK == 0).select(
            *group, F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("digest")
        )
    above = finish(nodes.where("idx = 0").select(*group, "block", _no_path().alias("path"), F.col("up").alias("top")))
    found = [c for c in above.columns if c not in (*group, "block", "path")]
    for i, (nodes, path) in reversed(list(enumerate(rounds))):
        own = nodes.select(*group, "block", "idx", path.alias("below"), *([] if i else carry))
        met = _joined(own, above, [*group, "block"]).withColumn("path", F.concat("below", "path"))
        above = met.select(*group, F.col("idx").alias("block"), "path", *found, *([] if i else carry))
    return above.drop("block")


def _no_path() -> Column:
    return F.expr("cast(array() as array<struct<left: string, right: string>>)")


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, leaf, further columns) with ``subroot``, the
    root of the row's source, ``root``, the root of all, and ``path``: from the
    leaf upwards, the digests to the left and to the right of the row's node in
    its run, as joined hex text, through the source's tree and then that of the
    sources."""

    def sources(roots: DataFrame) -> DataFrame:
        subroots = stored(roots.select("source", F.col("top").alias("digest")).withColumn("all", F.lit(0)), "merkle-subroots")
        placed = _place(subroots, ["all"], ["source"]).withColumn("subroot", F.col("digest"))
        top = _climb(placed, ["all"], ["source", "subroot"], lambda all_: all_)
        return top.select("source", F.lit(0).cast("bigint").alias("block"), "path", "subroot", F.col("top").alias("root"))

    carry = [c for c in rows.columns if c != "source"]
    placed = _place(rows, ["source"], ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    return _climb(placed, ["source"], carry, sources)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on the path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p.left, p.right)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, p: digest(p.left, node, p.right))
