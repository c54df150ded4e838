from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from churnscope.llm import queries, toxicity
from churnscope.llm.text_arrays import column_bytes
from churnscope.llm.toxicity import TermIndex, fit, isotonic, score_documents, term_counts, tokens


def brute(index_docs, weights, query, k):
    score = index_docs @ query
    order = np.lexsort((np.arange(len(score)), -score))[:k]
    return order[score[order] > 0], score


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("often", [1, 4, 100])
def test_search_is_exact(seed, often, monkeypatch):
    """Dense rows for nearly all terms, for some and for none."""
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "OFTEN", often)
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 7) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    raw = column_bytes(pa.array(texts))
    vocabulary = np.unique(tokens(*raw)[1])
    doc, term, count = term_counts(vocabulary, *raw)
    idf = np.random.default_rng(seed).uniform(0.1, 3, len(vocabulary))
    index = TermIndex(doc, term, count, len(texts), vocabulary, idf, np.zeros(len(texts)), np.arange(len(texts)))
    dense = np.zeros((len(texts), len(vocabulary)))
    dense[doc, term] = (1 + np.log(count)) * idf[term]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for i in range(0, 150, 7):
        found, cosine = index.nearest(*index.query(term[doc == i], count[doc == i]), 10)
        want, score = brute(dense, None, dense[i], 10)
        assert np.allclose(cosine, score[want]) and np.allclose(score[found], score[want])
    together = index.nearest_all([index.query(term[doc == i], count[doc == i]) for i in range(150)], 10)
    for i, (found, cosine) in enumerate(together):
        alone = index.nearest(*index.query(term[doc == i], count[doc == i]), 10)
        assert list(found) == list(alone[0]) and list(cosine) == list(alone[1])
    assert len(index.nearest(*index.query(term[:0], count[:0]), 10)[0]) == 0


def test_blocks_of_other_groups_are_skipped(monkeypatch):
    """Two groups without common words: a block product is asked only for a
    document's own group, and ``alike`` tells the groups apart."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"{'ab'[i % 2]}{j}" for j in range(30)], k=20)) for i in range(400)]
    raw = column_bytes(pa.array(texts))
    vocabulary = np.unique(tokens(*raw)[1])
    doc, term, count = term_counts(vocabulary, *raw)
    group = toxicity.alike(doc, term, np.ones(len(vocabulary)), 400)
    assert not set(group[::2]) & set(group[1::2])
    rank = np.empty(400, np.int64)
    rank[np.argsort(group, kind="stable")] = np.arange(400)
    index = TermIndex(rank[doc], term, count, 400, vocabulary, np.ones(len(vocabulary)), np.zeros(400), np.argsort(rank))
    for i in range(0, 400, 37):
        found, _ = index.nearest(*index.query(term[doc == i], count[doc == i]), 300)
        assert len(found) <= 200 and {int(index.ids[f]) % 2 for f in found} == {i % 2}


def test_a_long_text_and_several_slices(spark, docs_frame, monkeypatch):
    """Texts over one slice, and batches of several slices, score as alone."""
    monkeypatch.setattr(toxicity, "TOGETHER", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)] + ["vile"] * (20 * (i % 2)), k=30))) for i in range(40)]
    rows += [(100, " ".join(rng.choices([f"w{j}" for j in range(5000)], k=400_000))), (101, "vile " * 300_000)]
    frame = docs_frame(rows).coalesce(1)
    model = fit(frame, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in score_documents(frame, model).collect()}
    assert len(out) == 42 and set(out[101].neighbour_labels) == {1}
    assert out[101].score == score_documents(docs_frame([(101, rows[-1][1])]), model).collect()[0].score


def test_isotonic_is_monotone_and_pools():
    knots, values = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(values) >= 0).all() and 0 < values[0] and values[-1] < 1
    assert np.interp(0.2, knots, values) == np.interp(0.3, knots, values)


def test_finds_toxic_documents_and_ignores_held_out_labels(spark, docs_frame):
    rng = random.Random(5)
    plain = ["w" + str(i) for i in range(300)]
    vile = [f"vile{c}" for c in "abcdefghijklmnopqrst"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(plain, k=40) + rng.choices(vile, k=5 * toxic))))
        if i < 300:
            labels.append((i, int(toxic)))
    rows += [(1000, ""), (1001, None), (None, "vilea w1"), (0, rows[0][1])]
    frame = docs_frame(rows).selectExpr("*", "1 as score", "2 as n")
    label_frame = spark.createDataFrame([*labels, (5000, 1), (7, None), (None, 1)], "doc_id long, toxic int")
    out = score_documents(frame, fit(frame, label_frame)).collect()
    assert len(out) == len(rows)
    score = {r.doc_id: r.score for r in out}
    right = [(score[i] >= 0.3) == (i % 4 == 0) for i in range(300, 400)]
    assert sum(right) >= 95
    assert all(0 <= r.score <= 1 for r in out) and score[1000] == score[1001]
    assert [r.neighbours for r in out if r.doc_id == 1000] == [[]]


def test_no_labels_and_empty_table(spark, docs_frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    frame = docs_frame([(1, "a b")])
    assert [r.score for r in score_documents(frame, fit(frame, none)).collect()] == [0.0]
    assert score_documents(docs_frame([]), fit(docs_frame([]), none)).collect() == []


def test_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [(rows[r.doc_id].score, r.toxic) for r in labels if rows[r.doc_id].held_out]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.8


def test_copies_of_a_toxic_text_that_fill_a_third_of_the_table(spark, docs_frame):
    """All words of the copies are in more than a tenth of the documents."""
    rng = random.Random(8)
    plain = ["w" + str(i) for i in range(300)]
    vile = "vilea vileb vilec viled vilee vilef"
    rows = [(i, vile if i % 3 == 0 else " ".join(rng.choices(plain, k=30))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    frame = docs_frame([*rows, (900, "vilea vileb " + rows[1][1])])
    out = {r.doc_id: r for r in score_documents(frame, fit(frame, labels)).collect()}
    assert all((out[i].score >= 0.5) == (i % 3 == 0) for i in range(300, 600))
    assert all(out[i].neighbours and set(out[i].neighbour_labels) == {1} for i in range(0, 600, 3))


def test_every_word_of_the_examples_counts(spark, docs_frame):
    """A word of one example in a thousand still finds it."""
    rows = [(i, f"same words here plus w{i % 40}") for i in range(1500)] + [(2000, "hapax same"), (2001, "hapax words")]
    labels = spark.createDataFrame([*[(i, 0) for i in range(1500)], (2000, 1)], "doc_id long, toxic int")
    model = fit(docs_frame(rows), labels)
    out = {r.doc_id: r for r in score_documents(docs_frame(rows), model).collect()}
    assert out[2001].neighbours[0] == 2000
