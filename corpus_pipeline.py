"""Corpus pipeline: from raw documents to token ids.

``STAGES`` lists (name, function) in order.  Each function takes (spark, docs,
sf_dir), works on all of ``docs`` and returns the documents it keeps with the
columns of ``documents``; the last one returns token ids.  The output of a
stage is written as Parquet and read again as the next one's ``docs``; when a
stage starts, the intermediate tables of the one before are removed.

1. ``quality``: documents that the co-trained classifier rejects go.
2. ``near_duplicates``: one document of each class of near duplicates stays,
   the one with the smallest id.
3. ``repeats``: byte strings of 400 that still occur twice are cut out of the
   texts (wherever they occur); ``n_chars`` follows the text.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``encode``: SentencePiece ids, and the length of what they decode to.

A classifier has no SQL form, so ``ORACLE_SQL`` is None and the tests compare
the pipeline with brute-force versions of the stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import chosen_path, cotrain_quality, decontaminate, piece_codec, suffix_dedup
from churnscope.llm.storage import recorded, release
from churnscope.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last_stage: list[str] = []  # intermediate folders of the stage that ran last


def _stage(work: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last_stage)  # its output has been written
        with recorded(_last_stage):
            return work(spark, docs, sf_dir)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = cotrain_quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = cotrain_quality.score_documents(docs, model)
    return scored.where(F.col("quality") >= cotrain_quality.KEEP).select("row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(docs)
    stays = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    stays = stays.select("first.row_key")
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    if found.groupBy("row_key").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["row_key"])  # rows that repeat id and text
    return keyed.join(stays, "row_key", "left_semi").select(*docs.columns)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") == 0).select("row.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import numpy as np
    import public_tokenizers

    model = piece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))

    def row(e: piece_codec.Encoded) -> tuple:
        return len(e.ids), np.array(e.ids, np.int32), len(e.decoded)

    encoded = piece_codec.map_encoded(docs, model, row, "n_tokens long, ids array<int>, decoded_chars long")
    return encoded.select("doc_id", "n_tokens", "ids", "decoded_chars")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminate", decontaminated),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the ``documents`` of a folder."""
    docs, base = _table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
