"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group.  The groups are put in the
order of a 128-bit digest of their text, and the ordered sizes are cut into
at most ``shards`` contiguous runs so that the largest run is as small as
possible: a binary search over the capacity, each candidate checked greedily
(fill a shard up to the capacity, cut, go on).

Scale.  Row-level work is DataFrame operations only:

* one pass reduces every document to (id, size, crc, digest), which is stored;
* groups come from a partial aggregation, so a text that holds a third of all
  rows is one row per task before the shuffle;
* cumulative sizes are a window within each of ``2**13`` digest ranges plus
  the total of the ranges before it (a table of at most ``2**13`` rows);
* the greedy check never walks the groups.  Group ends are summarised as one
  (largest end) row per equal slice of the size axis, at most ``SLICES`` rows.
  Greedy over a subset of the ends gives capacities that surely suffice, and
  greedy over "any point of an unresolved slice may be an end" gives
  capacities that surely do not.  Only the slices that can still hold one of
  the cuts are sliced again, until both answers meet: the exact minimum;
* a document finds its shard by comparing its digest with the
  ``shards - 1`` cut digests, so no join meets the hot group;
* slots number the rows of a shard by (hash of the id modulo 1024, id), so
  one shard's rows are spread over 1024 window groups whatever the texts are.

Defined cases: NULL text has size 1 and groups with the empty text; an empty
table gives no rows; repeated rows share shard and differ in slot; fewer
groups than shards leave the last shards empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.storage import stored

RANGE_BITS = 13
SLICES = 1 << 15
SLOT_BUCKETS = 1024


class _Ends:
    """What is known of the cumulative group ends: ``sure`` holds some ends,
    ``open`` the (start, end] slices that hold further, unknown ones."""

    def __init__(self, total: int):
        self.total, self.sure, self.open = total, [0, total], [(0, total)]

    def refine(self, parts: list[tuple[int, int]], rows: list[tuple[int, int, int]]) -> None:
        """The ends in ``parts`` were summarised: ``rows`` are (smallest,
        largest, count) of the ends in each slice of them."""
        self.open = [s for s in self.open if not any(a <= s[0] and s[1] <= b for a, b in parts)]
        for low, high, n in rows:
            self.sure += [low, high]
            if n > 2:
                self.open.append((low, high - 1))
        self.sure = sorted(set(self.sure))
        self.open.sort()

    def below(self, x: int) -> int:
        """The largest known end that is at most x."""
        return self.sure[bisect_right(self.sure, x) - 1]

    def at_most(self, x: int) -> int:
        """No end above this one is at most x."""
        i = bisect_right(self.open, (x, float("inf"))) - 1
        if i >= 0 and self.open[i][0] < x:
            return max(self.below(x), min(x, self.open[i][1]))
        return self.below(x)

    def cuts(self, capacity: int, shards: int, end) -> list[int] | None:
        """Greedy filling; None if ``shards`` shards do not hold everything."""
        at, out = 0, []
        for _ in range(shards):
            nxt = end(min(at + capacity, self.total))
            if nxt <= at:
                return out if at >= self.total else None
            at = nxt
            out.append(at)
        return out if at >= self.total else None

    def search(self, low: int, high: int, shards: int, end) -> int:
        """The smallest capacity in [low, high] that greedy filling accepts;
        ``high`` is known to be enough."""
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, end) is None:
                low = mid + 1
            else:
                high = mid
        return high


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _slice_ends(groups: DataFrame, parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(smallest end, largest end, ends) of each slice of ``parts``, which are
    disjoint and in order; at most SLICES rows plus two per part."""
    width = max(1, -(-sum(b - a for a, b in parts) // SLICES))
    inside, part = F.lit(False), F.lit(0)
    for a, b in parts:
        inside = inside | ((F.col("end") > a) & (F.col("end") <= b))
        part = part + (F.col("end") > a).cast("int")
    rows = (
        groups.where(inside)
        .groupBy(part.alias("part"), F.expr(f"end div {width}").alias("slice"))
        .agg(F.min("end").alias("low"), F.max("end").alias("high"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return [(int(r["low"]), int(r["high"]), int(r["n"])) for r in rows]


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Cumulative ends of the shards, for ``groups`` with a column ``end``."""
    if total == 0:
        return []
    ends = _Ends(total)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    parts = list(ends.open)
    while True:
        ends.refine(parts, _slice_ends(groups, parts))
        enough = ends.search(low, high, shards, ends.below) if ends.cuts(high, shards, ends.below) else high
        least = ends.search(low, enough, shards, ends.at_most)
        low, high = least, enough
        if low == high:
            found = ends.cuts(high, shards, ends.below)
            if found is not None:
                return found
        # Cut j lies between its pessimistic place for the smallest capacity
        # and its optimistic place for the largest: look there again.
        parts, first, final = [], 0, 0
        for _ in range(shards):
            first, final = ends.below(min(first + low, total)), ends.at_most(min(final + high, total))
            near = [s for s in ends.open if s[1] >= first and s[0] <= final + high - low]
            if near and parts and near[0][0] <= parts[-1][1]:
                parts[-1] = (parts[-1][0], max(parts[-1][1], near[-1][1]))
            elif near:
                parts.append((near[0][0], near[-1][1]))
        if not parts:
            return ends.cuts(high, shards, ends.below)


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _digest(text).alias("digest"),
        ),
        "shard-rows",
    )
    sizes = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    sizes = sizes.withColumn("range", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int").bitwiseAND((1 << 16) - 1))
    sizes = sizes.withColumn("range", F.shiftright("range", 16 - RANGE_BITS))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # at most 2**RANGE_BITS rows
        sizes.groupBy("range")
        .agg(F.sum("size").alias("range_size"))
        .select("range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    groups = stored(
        sizes.withColumn("in_range", F.sum("size").over(within))
        .join(F.broadcast(offsets), "range")
        .select("digest", "size", (F.col("in_range") + F.col("offset")).alias("end")),
        "shard-groups",
    )
    head = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    cuts = minimax_cuts(groups, int(head["total"] or 0), int(head["largest"] or 0), shards)
    # the digest of the last group of each shard but the last
    last = sorted(r["digest"] for r in groups.where(F.col("end").isin(cuts[:-1])).select("digest").collect()) if cuts[1:] else []
    shard = F.lit(0)
    for d in last:
        shard = shard + (F.col("digest") > F.lit(d)).cast("int")
    placed = rows.withColumn("shard", shard).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int")
    )
    in_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    slots = (  # at most shards * SLOT_BUCKETS rows
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("slot_offset"))
    )
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "digest")
    return (
        placed.withColumn("in_bucket", F.row_number().over(in_bucket) - 1)
        .join(F.broadcast(slots), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("slot_offset") + F.col("in_bucket")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
