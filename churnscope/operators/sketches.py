"""Distinct and duplicate counts that merge (Q01, Q03, FE24).

The exact counts of ``quality`` read every row again whenever an export is
added.  Here each part (an export, a month, a contract) is read once and leaves
one row per column: its rows, its NULLs and a theta sketch of its values.  Those
rows merge into counts of any set of parts, and two parts can be compared.

A sketch holds the smallest hashes, at most ``2**lg`` of them (8 bytes each),
so a state is bounded however many values it has seen; a column with fewer
values is counted exactly.  The relative standard error is at most
1 / sqrt(2**lg - 1).

Defined cases: NULLs are counted apart and are no value; an empty part leaves no
row; merged counts of no parts are an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LG = 14
FIELDS = "part string, column_name string, n_rows bigint, n_nulls bigint, sketch binary"


def relative_error(lg: int = LG, deviations: float = 3.0) -> float:
    """Bound of the relative error at so many standard deviations."""
    return deviations / math.sqrt((1 << lg) - 1)


def sketch_parts(df: DataFrame, columns: list[str], part: str, lg: int = LG) -> DataFrame:
    """(part, column_name, n_rows, n_nulls, sketch) of every part and column:
    one aggregation of one scan, one state per task and part before the shuffle."""
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.theta_sketch_agg(F.col(c).cast("string"), lg).alias(f"_s{i}"))
        aggs.append(F.count(c).alias(f"_c{i}"))
    wide = df.groupBy(F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    entries = [
        F.struct(F.lit(c).alias("column_name"), (F.col("n_rows") - F.col(f"_c{i}")).alias("n_nulls"), F.col(f"_s{i}").alias("sketch"))
        for i, c in enumerate(columns)
    ]
    long = wide.select("part", "n_rows", F.explode(F.array(*entries)).alias("e"))
    return long.select("part", "e.column_name", "n_rows", "e.n_nulls", "e.sketch")


def store_parts(sketches: DataFrame, path: str) -> None:
    """Adds the parts to the table at ``path``; parts that it has already are
    replaced, the others are not touched."""
    rows = sketches.withColumn("of_part", F.coalesce("part", F.lit("__none__")))
    rows.write.partitionBy("of_part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_parts`` wrote."""
    return spark.read.schema(FIELDS).parquet(path)


def merged_counts(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """Per column over all parts given: (column_name, n_rows, n_nulls, distinct,
    duplicates): estimates, exact while a column has fewer than 2**lg values.
    ``duplicates`` counts the rows beyond the first of each value, NULLs left out."""
    merged = sketches.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
        F.theta_sketch_estimate(F.theta_union_agg("sketch", lg)).cast("bigint").alias("distinct"),
    )
    known = F.col("n_rows") - F.col("n_nulls")
    return merged.select("column_name", "n_rows", "n_nulls", "distinct", F.greatest(known - F.col("distinct"), F.lit(0)).alias("duplicates"))


def kept_from_before(sketches: DataFrame, lg: int = LG) -> DataFrame:
    """Per column and part, in the order of the parts: how many values the part
    before it has (``before``), how many of them are in this part too (``kept``),
    and how many of this part are new against it (``added``).  The first part has
    NULLs.  The windows hold one row per part."""
    window = Window.partitionBy("column_name").orderBy("part")
    paired = sketches.withColumn("last", F.lag("sketch").over(window))
    count = lambda s: F.theta_sketch_estimate(s).cast("bigint")
    both = F.when(F.col("last").isNotNull(), F.theta_intersection("last", "sketch"))
    return paired.select(
        "column_name", "part", count(F.col("last")).alias("before"), count(both).alias("kept"),
        F.when(F.col("last").isNotNull(), count(F.theta_difference("sketch", "last"))).alias("added"),
    )


def exact_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same counts without sketches: (column_name, n_rows, n_nulls, distinct,
    duplicates).  Rows are counted per value before a value is counted once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    out = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("value").alias("distinct"),
    )
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_nulls") - F.col("distinct"))
