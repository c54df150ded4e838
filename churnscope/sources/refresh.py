"""Refresh of a derived table without a rebuild (IO04, IO08, IO09).

A table is kept in parts, folders by a hash of the id, beside a manifest with a
fingerprint of the *source* rows of each part: their number and two
order-independent sums of row hashes.  A refresh takes the fingerprints of the
new source (one aggregation, a row per part and task), compares them with the
manifest, and derives and rewrites only the parts that differ; parts that have
lost all rows are removed.  Unchanged parts are not derived, read or touched.

The parts are replaced by one dynamic partition overwrite.  The manifest goes
last, and its parts are struck out first, so that a refresh that was cut off is
made good by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.sources.io import replace_folder

PART = "part"


@dataclass(frozen=True)
class Refreshed:
    path: str
    rewritten: tuple[int, ...]
    removed: tuple[int, ...]
    unchanged: int


def part_of(id_col: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")


def fingerprints(source: DataFrame, id_col: str, parts: int) -> DataFrame:
    """(part, n, sum, xor): equal for equal multisets of rows, but for collisions
    of two 64-bit hashes at once."""
    row = F.struct(*[F.col(f"`{c}`") for c in source.columns])
    # a NULL hashes like nothing: its place is hashed beside it
    absent = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in source.columns])
    return source.groupBy(part_of(id_col, parts).alias(PART)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(row, absent).cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64(F.lit(11), absent, row)).alias("xor"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def refresh_table(
    source: DataFrame, base: str, name: str, derive: Callable[[DataFrame], DataFrame], id_col: str, parts: int = 64
) -> Refreshed:
    """Brings ``base/name`` up to ``derive(source)``.  ``derive`` must work row by
    row, or at least within a part, and keep nothing of the ids' order."""
    spark = source.sparkSession
    path, manifest = f"{base.rstrip('/')}/{name}", f"{base.rstrip('/')}/{name}.manifest"
    kind = "part int, n long, sum decimal(38,0), xor long"
    now = {r[PART]: (r["n"], r["sum"], r["xor"]) for r in fingerprints(source, id_col, parts).collect()}  # a row per part
    before = {r[PART]: (r["n"], r["sum"], r["xor"]) for r in spark.read.schema(kind).parquet(manifest).collect()} if _exists(spark, manifest) else {}
    changed = sorted(p for p in now if before.get(p) != now[p])
    gone = sorted(set(before) - set(now))

    def write_manifest(rows: dict) -> None:
        staged = f"{manifest}.staged"
        spark.createDataFrame([(p, *v) for p, v in rows.items()], kind).coalesce(1).write.mode("overwrite").parquet(staged)
        replace_folder(spark, staged, manifest)

    if changed or gone:
        if before:
            write_manifest({p: v for p, v in before.items() if p not in changed})
        made = derive(source.where(part_of(id_col, parts).isin(changed)))
        made = made.withColumn(PART, part_of(_derived_id(made, id_col), parts))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
        for p in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PART}={p}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        write_manifest(now)
    return Refreshed(path, tuple(changed), tuple(gone), len(now) - len(changed))


def _derived_id(derived: DataFrame, id_col: str) -> str:
    """The id's column after ``derive``, which may have renamed customerID."""
    return id_col if id_col in derived.columns else "customer_id"


def read_table(spark: SparkSession, refreshed: Refreshed) -> DataFrame:
    return spark.read.parquet(refreshed.path).drop(PART)
