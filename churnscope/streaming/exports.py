"""Account exports arriving in a folder, processed with Structured Streaming.

The analysed project loads one export at a time.  When exports keep
arriving, the same reading rules (declared raw schema, header, fail-fast,
whitespace kept) and the same row-level cleaning and typing apply unchanged
to a streaming DataFrame, because those operators are pure projections.
Outputs are appended to Parquet with a checkpoint folder that the caller
names, so a restarted query resumes exactly where it stopped.

Churn counts per segment are the one stateful piece: the state is one row
per segment (bounded by the label domain), kept by Spark's state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from churnscope.functions.schemas import RAW_SCHEMA
from churnscope.operators import quality
from churnscope.operators.cleaning import build_accounts, clean
from churnscope.sources.io import CSV_READ_OPTIONS


def stream_raw_exports(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw accounts from every CSV export that lands in ``folder``."""
    reader = spark.readStream.schema(RAW_SCHEMA).options(**CSV_READ_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.csv(folder)


def clean_stream(raw: DataFrame) -> DataFrame:
    """The analysis-frame cleaning, applied per micro-batch (stateless)."""
    return clean(raw)


def typed_stream(raw: DataFrame) -> DataFrame:
    """The typed accounts table, applied per micro-batch (stateless)."""
    return build_accounts(raw)


def watched_stream(clean_rows: DataFrame, name: str) -> DataFrame:
    """The cleaned stream, whose batches also measure the data rules (all but
    the repeated ids, which need rows of other batches)."""
    return quality.watched(clean_rows, name, unique_ids=False)


def batch_rules(query: StreamingQuery, name: str) -> list[dict]:
    """Of every batch still in the query's record that had rows: its number and
    the violations per rule."""
    out = []
    for p in query.recentProgress:
        row = p.observedMetrics.get(name)
        if row is not None and p.numInputRows:
            out.append({"batch": p.batchId} | {rule: row[f"r{i}"] for i, rule in enumerate(quality.ASSERTION_RULES) if i})
    return out


def segment_counts_stream(typed: DataFrame, keys: list[str]) -> DataFrame:
    """Running accounts and churned accounts per segment (complete mode)."""
    return typed.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_customers"),
        F.sum("churn_flag").cast("bigint").alias("churned"),
    )


def append_to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a cleaned stream to a Parquet table; ``once`` processes every
    export present now and stops (availableNow), else it keeps running.  A query
    restarted with the same ``checkpoint`` folder takes only new exports."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.outputMode("append").start()
