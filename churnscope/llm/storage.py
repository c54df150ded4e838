"""Intermediate tables in the shared checkpoint folder.

``stored`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and
reads it back: lineage is cut, and a lost executor only means reading the
files again.  The folders made so far are remembered, so that a caller which
knows that their readers are done (the pipeline, between two stages; a test)
can remove them with ``release``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from churnscope.session import ensure_checkpoint_dir

_made: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """``stored`` with the rows dealt by ``key`` into ``buckets`` files, so that
    joins and groups by ``key`` shuffle them no more.  The catalog entry that
    bucketing needs is dropped again; the files stay."""
    path, name, spark = scratch_path(df.sparkSession, tag), f"{tag}_{uuid.uuid4().hex}".replace("-", "_"), df.sparkSession
    dealt = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    dealt.option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


@contextmanager
def recorded(folders: list[str]) -> Iterator[None]:
    """Puts the folders made inside the block into ``folders``."""
    before = len(_made)
    try:
        yield
    finally:
        folders += _made[before:]


def release(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Removes folders that ``stored`` and ``scratch_path`` made, all by
    default; nothing may read them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in list(_made if folders is None else folders):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _made:
            _made.remove(name)
    if folders:
        folders.clear()


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def buckets_for(total: int, each: int, least: int = 64) -> int:
    """How many hash buckets hold ``total`` units at about ``each`` apiece: a
    power of two that grows with the input."""
    n = least
    while n * each < total:
        n *= 2
    return n


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row_key): the text never NULL, and a hash of id and text
    that repeated rows share.  Joins on row_key alone trust its 64 bits: two of n
    different rows share one with a probability of about n^2 / 2^65."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(F.col(id_col), text).alias("row_key"),
    )


def arrow_fields(ddl: str) -> pa.Schema:
    """Names and Arrow types of a DDL field list.  Batches built with them agree
    in their schema even where a slice holds only NULLs or empty lists."""
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl)])


def arrow_columns(rows: list[tuple], fields: pa.Schema) -> list[pa.Array]:
    """One typed column per field from row tuples."""
    return [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(fields), fields)]
