from __future__ import annotations

import public_tokenizers
import sentencepiece
import corpus_pipeline
from churnscope.llm import cotrain_quality
from churnscope.llm.suffix_dedup import kept_text

from .test_chosen_path import brute as classes_of
from .test_decontaminate import plain
from .test_suffix_dedup import brute as repeats_of


def expected(docs, labels, benchmark, kept_ids):
    """doc_id -> ids by brute force; ``kept_ids`` pass the classifier."""
    rows = [(i, t) for i, t in docs if i in kept_ids]
    root, _ = classes_of(rows)
    first = {}
    for (i, _), c in zip(rows, root):
        first[c] = min(first.get(c, i), i)
    rows = [(i, t) for i, t in rows if i in first.values()]
    runs = repeats_of([t.encode() for _, t in rows], 400)
    rows = [(i, kept_text(t.encode(), r).decode("utf-8", "ignore")) for (i, t), r in zip(rows, runs)]
    items = [plain(t) for t in benchmark]
    rows = [(i, t) for i, t in rows if not any(b and b in plain(t) for b in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: library.encode(t) for i, t in rows}


def test_pipeline_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = cotrain_quality.score_documents(docs, cotrain_quality.fit(docs, labels), carry=["doc_id"]).collect()
    kept = {r.row.doc_id for r in scored if r.quality >= cotrain_quality.KEEP}
    benchmark = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = expected([(r.doc_id, r.text) for r in docs.collect()], labels, benchmark, kept)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) for r in got.values())
    assert 0 < len(want) < docs.count()


def test_stages_keep_the_columns_and_one_of_repeated_rows(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    some = docs.union(docs.where("doc_id < 20"))
    schema = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, some, d)
        assert out.dtypes == schema
        if name == "near_duplicates":
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
        assert stage(spark, some.limit(0), d).count() == 0


def test_stages_take_nulls(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (3, "", "en", "s", 0), (4, "é " * 300, "fr", "s", 600)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert len(out) <= 4 and (name != "encode" or len(out) == 4)
