"""Sources and sinks (IO01-IO10).

* CSV exports are read by column name (any order, further columns ignored, a
  missing one is an error), with quotes doubled inside quoted fields, the
  declared raw types (no inference; a bad value fails the job), only the empty
  field as NULL unless further words are given, and whitespace kept (a blank
  total held as one space must survive the read).
* SQL text runs on Spark's own engine over registered views, or is pushed
  to a JDBC source (the executors read the database directly).
* Tables are written as Parquet.  An optional layout clusters rows by the
  columns later filters use (range partitioning + sort within partitions),
  so Parquet min/max statistics let scans skip row groups, along a Z curve over
  several columns, so that a filter on any of them does, or splits the
  folder by a low-cardinality column so a filter on it prunes whole
  directories.  Bloom filters serve look-ups by id.
* ``save_checked`` measures the data rules in the job that writes, and only a
  table that keeps them takes the place of the one before.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnscope.functions.schemas import RAW_SCHEMA
from churnscope.operators import quality
from churnscope.operators.selection import id_number, quantile_values, shared_bytes
from churnscope.session import ensure_checkpoint_dir

CSV_READ_OPTIONS = {
    "header": "true",
    "enforceSchema": "false",
    "mode": "FAILFAST",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# FIXED VALUES: words that the analysed project's CSV reader takes as missing.
NULL_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_raw_csv(
    spark: SparkSession, path: str, null_words: tuple[str, ...] = (), multi_line: bool = False
) -> DataFrame:
    """IO01: the raw account export; a missing path raises FileNotFoundError, a
    missing column ValueError.  ``null_words`` (e.g. ``NULL_WORDS``) are read as
    NULL too; ``multi_line`` allows line ends inside quoted fields, at the price
    of not splitting files."""
    options = CSV_READ_OPTIONS | {"multiLine": str(multi_line).lower()}
    try:
        text = spark.read.options(**options).csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"raw account export not found at {path}") from exc
        raise
    missing = [f.name for f in RAW_SCHEMA.fields if f.name not in text.columns]
    if missing:
        raise ValueError(f"raw account export at {path} lacks the columns {', '.join(missing)}")

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~c.isin(*null_words), c) if null_words else c

    return text.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


def write_raw_csv(df: DataFrame, path: str) -> str:
    """Write raw accounts as a header CSV export (whitespace preserved)."""
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def load_raw_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """IO02: bulk-load a CSV export into a managed table (replacing it)."""
    read_raw_csv(spark, path).write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def reset_namespace(spark: SparkSession, namespace: str, drop_existing: bool = False) -> None:
    """IO04: make ``namespace`` exist; with ``drop_existing`` recreate it empty.

    Dropping is opt-in because it deletes every table in the namespace."""
    if drop_existing:
        spark.sql(f"DROP DATABASE IF EXISTS `{namespace}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`")


def postgres_options(
    host: str | None = None, port: int | None = None, database: str | None = None,
    user: str | None = None, password: str | None = None,
) -> dict[str, str]:
    """JDBC options of a PostgreSQL source; what is not given comes from
    PG_HOST, PG_PORT, PG_DB, PG_USER and PG_PASSWORD, else from defaults."""
    env = os.environ.get
    host, port = host or env("PG_HOST", "localhost"), port or env("PG_PORT", "5432")
    return {
        "url": f"jdbc:postgresql://{host}:{port}/{database or env('PG_DB', 'saas_churn')}",
        "driver": "org.postgresql.Driver",
        "user": user or env("PG_USER", "postgres"),
        "password": password or env("PG_PASSWORD", ""),
    }


PARTITION_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def jdbc_options_for(query: str, jdbc_options: dict[str, str]) -> dict[str, str]:
    """The options of a JDBC read.  A partitioned read must name a table, so the
    query becomes a derived one; Spark then reads its ranges in parallel."""
    if any(o in jdbc_options for o in PARTITION_OPTIONS[:3]):
        lacking = [o for o in PARTITION_OPTIONS if o not in jdbc_options]
        if lacking:
            raise ValueError(f"a partitioned read also needs {', '.join(lacking)}")
        return jdbc_options | {"dbtable": f"({query.strip().rstrip(';')}) q"}
    return jdbc_options | {"query": query}


def read_query(
    spark: SparkSession,
    query: str,
    jdbc_options: dict[str, str] | None = None,
) -> DataFrame:
    """IO05: run SQL text.  Without ``jdbc_options`` it runs on Spark over the
    session's tables and views; with them (url, user, password, driver, see
    ``postgres_options``; with partitionColumn, lowerBound, upperBound and
    numPartitions one task per range) the query is pushed to the database and
    read by the executors."""
    if not jdbc_options:
        return spark.sql(query)
    return spark.read.format("jdbc").options(**jdbc_options_for(query, jdbc_options)).load()


def save_table(
    df: DataFrame,
    base: str,
    name: str,
    sort_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    num_partitions: int | None = None,
    zorder_by: list[str] | None = None,
    bloom: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> str:
    """IO06 + IO10: write ``df`` as Parquet under ``base/name`` and return the
    path.  ``sort_by`` clusters rows for min/max skipping; ``partition_by``
    splits folders by (low-cardinality) columns.  ``sort_by`` should end with a
    unique column: range bounds can then cut a hot value into several tasks.
    With ``partition_by`` rows are dealt by range of those columns and the sort
    columns (or a row hash), so a task writes few folders and a hot folder has
    several writers.  ``zorder_by`` orders the rows along a Z curve over those
    columns, ties by ``sort_by``; ``bloom`` adds Bloom filters for equality
    look-ups; ``options`` go to the Parquet writer."""
    path = f"{base.rstrip('/')}/{name}"
    out = df
    if zorder_by:
        curve = [*(partition_by or []), "_curve", *(sort_by or [])]
        out = out.withColumn("_curve", zorder_key(df, zorder_by))
        keys = [*curve, *([] if sort_by else [F.xxhash64(*df.columns)])]
        out = out.repartitionByRange(num_partitions, *keys) if num_partitions else out.repartitionByRange(*keys)
        out = out.sortWithinPartitions(*curve).drop("_curve")
    elif sort_by or partition_by:
        tie = [] if sort_by else [F.xxhash64(*df.columns)]
        keys = [*(partition_by or []), *(sort_by or []), *tie]
        out = out.repartitionByRange(num_partitions, *keys) if num_partitions else out.repartitionByRange(*keys)
        out = out.sortWithinPartitions(*(partition_by or []), *(sort_by or []))
    writer = out.write.mode("overwrite").options(**(options or {}))
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


ZORDER_BITS = 4  # per column


def zorder_key(df: DataFrame, columns: list[str]) -> Column:
    """The place of a row on a Z curve: the columns' codes with their bits
    interleaved.  A code is the number of the value's quantile range, spread over
    ``ZORDER_BITS`` bits (so a flag sets the first bit); strings are read by the
    bytes after what all values share, and NULL comes first."""
    numeric = {}
    for c in columns:
        if isinstance(df.schema[c].dataType, StringType):
            ends = df.agg(F.min(c), F.max(c)).first()
            numeric[c] = id_number(F.col(c), shared_bytes(ends[0] or "", ends[1] or ""))
        else:
            numeric[c] = F.col(c).cast("double")
    levels = 1 << ZORDER_BITS
    named = df.select(*[x.alias(f"_z{i}") for i, x in enumerate(numeric.values())])
    cuts = quantile_values(named, named.columns, [k / levels for k in range(levels + 1)])
    key = F.lit(0).cast("bigint")
    for i, x in enumerate(numeric.values()):
        edges = sorted({v for (_, name, _), v in cuts.items() if name == f"_z{i}"})[:levels]
        code = F.lit(0)
        for e in edges[1:]:
            code = code + F.coalesce((x >= F.lit(e)).cast("int"), F.lit(0))
        code = F.floor(code * levels / max(1, len(edges))).cast("bigint")
        for bit in range(ZORDER_BITS):
            own = F.shiftright(code, bit).bitwiseAND(F.lit(1))
            key = key + F.shiftleft(own, bit * len(columns) + len(columns) - 1 - i)
    return key


def save_checked(df: DataFrame, base: str, name: str, **layout) -> tuple[DataFrame, bool]:
    """Writes accounts with ``save_table`` and measures the data rules in the
    same job.  Returns the rule table and whether all rules held.  Only then does
    the new table replace ``base/name``; one that breaks a rule is left in
    ``base/name.rejected`` and the table before it stays as it was."""
    spark = df.sparkSession
    metrics = Observation(f"rules-{uuid.uuid4().hex}")
    staged = f"{name}.staged-{uuid.uuid4().hex}"
    path = save_table(quality.watched(df, metrics), base, staged, **layout)
    rules = quality.rules_of(spark, metrics.get)
    passed = all(r.passed for r in rules.collect())
    replace_folder(spark, path, f"{base.rstrip('/')}/{name}" + ("" if passed else ".rejected"))
    return rules, passed


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Moves the folder ``source`` to ``target``; what was there goes after the
    new one is in its place."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    old = to_path(f"{target}.old-{uuid.uuid4().hex}")
    had = fs.exists(to_path(target))
    if had and not fs.rename(to_path(target), old) or not fs.rename(to_path(source), to_path(target)):
        raise OSError(f"cannot move {source} to {target}")
    if had:
        fs.delete(old, True)


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """IO07: read a table written by ``save_table``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster), for intermediate tables a job writes and reads back."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/churnscope-{label}-{uuid.uuid4().hex}"
