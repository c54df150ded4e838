"""Global ranks, NTILE buckets and top-n per group, without a single partition.

``ntile(5).over(Window.orderBy(k))`` makes Spark move every row into one
partition and sort it there: at scale that is one task holding the whole
table.  ``global_rank`` instead does what a distributed sort does:

1. range-partition the rows by the full sort key (the unique id is the last
   key, so even one hot value is split across many partitions) and sort
   within each partition;
2. tag each row with ``monotonically_increasing_id`` (partition index in the
   high bits, position within the partition in the low bits);
3. checkpoint to the shared checkpoint folder, which fixes the tags and cuts
   the lineage (a lost executor re-reads the files instead of re-sorting);
4. count rows per partition (one row per partition), turn the counts into
   start offsets with a window over those few rows, and join the offsets
   back.  The offsets table has exactly one row per range partition, a
   bound known before the join, so it is broadcast.

rank = offset(partition) + position + 1, identical to ``row_number`` over the
same total order.  NTILE follows from the rank and the row count with the
standard rule (the first ``n mod k`` buckets hold one extra row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.session import ensure_checkpoint_dir

_PART_BITS = 33  # monotonically_increasing_id: partition index << 33 | position


def _order_key_columns(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _range_partition(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range partitions by ``keys``.  Without an explicit count Spark starts
    from ``spark.sql.shuffle.partitions`` and AQE may merge adjacent small
    ranges (order is kept: merged partitions are contiguous ranges), so small
    inputs do not pay for hundreds of tiny tasks and large ones keep their
    parallelism."""
    if num_partitions:
        return df.repartitionByRange(num_partitions, *keys)
    return df.repartitionByRange(*keys)


def global_rank(
    df: DataFrame,
    order: list[Column | str],
    rank_col: str = "global_rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` (1..n, bigint) = position in the total order ``order``.

    ``order`` must be a total order (end it with a unique key) for the rank
    to be deterministic.  Columns of ``df`` are kept.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = _order_key_columns(order)
    tagged = (
        _range_partition(df, keys, num_partitions)
        .sortWithinPartitions(*keys)
        .withColumn("_gr_tag", F.monotonically_increasing_id())
    )
    # Reliable checkpoint: fixes the tags (they depend on partition layout).
    tagged = tagged.checkpoint(eager=True)
    pid = F.shiftright(F.col("_gr_tag"), _PART_BITS)
    counts = tagged.groupBy(pid.alias("_gr_pid")).agg(F.count(F.lit(1)).alias("_gr_n"))
    offsets = counts.select(
        "_gr_pid",
        (F.sum("_gr_n").over(Window.orderBy("_gr_pid")) - F.col("_gr_n")).alias("_gr_off"),
    )
    # One row per range partition: a bound fixed before the join.
    joined = tagged.join(F.broadcast(offsets), pid == F.col("_gr_pid"), "inner")
    position = F.col("_gr_tag") - F.shiftleft(F.col("_gr_pid"), _PART_BITS)
    return joined.withColumn(rank_col, (F.col("_gr_off") + position + 1).cast("bigint")).drop(
        "_gr_tag", "_gr_pid", "_gr_off"
    )


def ntile_from_rank(rank: Column, total: Column, buckets: int) -> Column:
    """NTILE bucket (1..buckets) of 1-based ``rank`` among ``total`` rows.

    Same rule as SQL NTILE: the first ``total mod buckets`` buckets get
    ``total div buckets + 1`` rows, the rest ``total div buckets``.
    """
    q = F.floor(total / buckets).cast("bigint")
    r = (total % buckets).cast("bigint")
    big = r * (q + 1)
    first = F.floor((rank - 1) / (q + 1)).cast("bigint") + 1
    rest = F.floor((rank - big - 1) / F.greatest(q, F.lit(1))).cast("bigint") + r + 1
    return F.when(rank <= big, first).otherwise(rest).cast("int")


def global_ntile(
    df: DataFrame,
    order: list[Column | str],
    buckets: int,
    out_col: str,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col`` = NTILE(buckets) over the total order ``order``."""
    ranked = global_rank(df, order, "_nt_rank", num_partitions)
    total = ranked.select(F.count(F.lit(1))).scalar()
    return ranked.withColumn(
        out_col, ntile_from_rank(F.col("_nt_rank"), total, buckets)
    ).drop("_nt_rank")


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Rows with ``row_number() <= n`` within each group of ``keys``.

    Written as a filter on ``row_number`` so Spark plans a WindowGroupLimit:
    each map task keeps only its own top ``n`` per group before the shuffle,
    so a group holding a third of all rows still ships only ``n`` rows per
    task.
    """
    w = Window.partitionBy(*keys).orderBy(*_order_key_columns(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


HELD_ROWS = 1 << 16  # a task's state goes on its way beyond this many rows


def _first_rows(group: list[str], keys: list[tuple[str, str]], n: int):
    """Arrow batches to the first ``n`` rows of each group in the task.  ``_size``
    of a group's first row adds up the rows seen, the others carry 0."""

    def reduce(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code = np.zeros(len(table), np.int64)
        for g in group:
            one = pc.dictionary_encode(table[g].combine_chunks(), null_encoding="encode")
            one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
            code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = pc.sort_indices(table.append_column("_group", pa.array(code)), sort_keys=[("_group", "ascending"), *keys])
        table, code = table.take(order), code[order.to_numpy()]
        start = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        size = np.zeros(len(code), np.int64)
        if len(start):
            size[start] = np.add.reduceat(table["_size"].to_numpy(), start)
        at = table.schema.get_field_index("_size")
        table = table.set_column(at, table.schema.field(at), pa.array(size))
        return table.filter(pa.array(place < n))

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            held = reduce(some if held is None else pa.concat_tables([held, some]))
            if len(held) > HELD_ROWS:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return run


def top_n_with_size(
    df: DataFrame, group: list[str], order: list[tuple[str, bool]], n: int, rank_col: str, size_col: str
) -> DataFrame:
    """The first ``n`` rows per ``group`` in ``order`` (column, ascending), with
    their rank and the rows of the whole group, from one read of ``df``.

    Each task keeps ``n`` rows and a count per group (and sends them early when
    it has very many groups); only those are shuffled and ranked.  NULLs order as
    in Spark: first ascending, last descending; a NULL group is a group."""
    taken, keys, marks = [], [], {}
    for i, (c, ascending) in enumerate(order):
        null = F.col(c).isNull()
        nan = F.isnan(c) if df.schema[c].dataType.typeName() in ("float", "double") else F.lit(False)
        low, high = (null, nan) if ascending else (nan, null)
        marks[f"_mark{i}"] = F.when(low, 0).when(high, 2).otherwise(1)
        keys += [(f"_mark{i}", "ascending"), (c, "ascending" if ascending else "descending")]
        taken.append(F.col(c).asc() if ascending else F.col(c).desc())
    marked = df.withColumns(marks | {"_size": F.lit(1).cast("bigint")})
    some = marked.mapInArrow(_first_rows(group, keys, n), marked.schema).drop(*marks)
    window = Window.partitionBy(*group)
    ranked = some.withColumns({rank_col: F.row_number().over(window.orderBy(*taken)), size_col: F.sum("_size").over(window)})
    return ranked.where(F.col(rank_col) <= n).drop("_size")


def prefix_sums(
    df: DataFrame,
    order_col: str,
    weights: list[str],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over rows with a smaller ``order_col``
    (unique per row, e.g. a histogram's value), for each weight column.

    Distributed like ``global_rank``: range partitions by the key (their ids
    fixed by a reliable checkpoint), running sums within each partition (a
    window per partition), and per-partition totals turned into offsets from
    a table with one row per partition, broadcast to the rows.  No step
    gathers the rows into one task, however many distinct keys there are.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parted = (
        _range_partition(df, [F.col(order_col)], num_partitions)
        .withColumn("_ps_pid", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    within = Window.partitionBy("_ps_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("_ps_pid").agg(*[F.sum(w).alias(f"_ps_t_{w}") for w in weights])
    before_parts = Window.orderBy("_ps_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_ps_pid",
        *[F.coalesce(F.sum(f"_ps_t_{w}").over(before_parts), F.lit(0)).alias(f"_ps_o_{w}") for w in weights],
    )
    out = parted.withColumns(
        {f"{w}_before_in_part": F.coalesce(F.sum(w).over(within), F.lit(0)) for w in weights}
    ).join(F.broadcast(offsets), "_ps_pid", "inner")
    return out.select(
        *df.columns,
        *[(F.col(f"{w}_before_in_part") + F.col(f"_ps_o_{w}")).alias(f"{w}_before") for w in weights],
    )
