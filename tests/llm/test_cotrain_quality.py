from __future__ import annotations

import random
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa

from churnscope.llm import cotrain_quality as cq
from churnscope.llm import queries
from churnscope.llm.cotrain_quality import fit, score_documents, text_features
from churnscope.llm.text_arrays import column_bytes


def test_text_features_of_each_document_are_its_own():
    texts = ["", "Good plain words here.", "BAD!! BAD!! BAD!!", "x " * 4000, "é | é | é"]
    together = text_features(*column_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], text_features(*column_bytes(pa.array([t])))[0])
    assert np.isfinite(together).all()


def in_memory(docs, label):
    """The rounds with everything in arrays: (score by id, pseudo-labels by round)."""
    rows = [r for r in docs]
    text = text_features(*column_bytes(pa.array([r.text or "" for r in rows]))).astype("<f4").astype(float)
    values = [["=" + r.source if r.source is not None else "" for r in rows], ["=" + r.lang if r.lang is not None else "" for r in rows],
              [f"={int(np.floor(np.log2(r.n_chars + 1)))}" for r in rows]]
    order = sorted((i for i, r in enumerate(rows) if r.doc_id in label), key=lambda i: (zlib.crc32(str(rows[i].doc_id).encode()), rows[i].doc_id))
    y = np.array([label[rows[i].doc_id] for i in order], float)
    aside = np.arange(len(y)) % 4 == 3
    train, check = [i for i, a in zip(order, aside) if not a], [i for i, a in zip(order, aside) if a]
    yt, yc, free = y[~aside], y[aside], [i for i, r in enumerate(rows) if r.doc_id not in label]
    base, weight = yt.mean(), lambda n: min(0.5, len(train) / n) if n else 0.0

    def meta_x(pseudo):
        x = np.zeros((len(rows), 3))
        own = dict(zip(train, yt))
        w = weight(sum(v is not None for v in pseudo.values()))
        for k, vals in enumerate(values):
            pos, neg = {}, {}
            for given, factor in ((own, 1.0), (pseudo, w)):
                for i, v in given.items():
                    pos[vals[i]] = pos.get(vals[i], 0.0) + factor * v
                    neg[vals[i]] = neg.get(vals[i], 0.0) + factor * (1 - v)
            for i, v in enumerate(vals):
                less = own.get(i)
                a, b = pos.get(v, 0.0) - (less or 0.0), neg.get(v, 0.0) - (0.0 if less is None else 1 - less)
                x[i, k] = np.log((max(a, 0) + 2 * base) / (max(b, 0) + 2 * (1 - base))) - np.log(base / (1 - base))
        return x

    view = cq._fitted(text[train], yt).calibrated(text[check], yc)
    x = meta_x({})
    meta = cq._fitted(x[train], yt).calibrated(x[check], yc)
    taught = []
    for _ in range(cq.ROUNDS):
        by_text = cq._taught(view, cq._teaches(view, text[check], yc), text[free])
        by_meta = cq._taught(meta, cq._teaches(meta, x[check], yc), x[free])
        taught.append((int((~np.isnan(by_text)).sum()), int((~np.isnan(by_meta)).sum())))
        new = view
        told = ~np.isnan(by_meta)
        if told.any():
            for _step in range(cq.STEPS):
                a = cq._sums(view.standard(text[train]), yt, new.weights)
                b = cq._sums(view.standard(text[free][told]), by_meta[told], new.weights)
                w = weight(told.sum())
                new = replace(new, weights=cq._newton(new.weights, a[0] + w * b[0], a[1] + w * b[1], cq.RIDGE)[0])
        if taught[-1] == (0, 0):
            break
        view = new.calibrated(text[check], yc)
        if taught[-1][0]:
            x = meta_x({i: v for i, v in zip(free, by_text) if not np.isnan(v)})
            meta = cq._fitted(x[train], yt).calibrated(x[check], yc)
    both = np.column_stack((view.log_odds(text), meta.log_odds(x)))
    combine = cq._logistic(both[check], yc, 0.1)
    return {r.doc_id: float(s) for r, s in zip(rows, cq._sigmoid(cq._ones(both) @ combine))}, tuple(taught)


def test_rounds_equal_the_same_in_memory(spark):
    """All unlabelled documents take part; a tenth of the labels are known."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").where("doc_id % 5 < 2")
    fitted = fit(docs, labels, carry=("doc_id",))
    label = {r.doc_id: r.quality for r in labels.collect()}
    want, taught = in_memory(docs.collect(), label)
    assert fitted.model.taught == taught and max(t[0] for t in taught) > 300
    got = {r.row.doc_id: r.quality for r in cq.score_features(fitted.features, fitted).collect()}
    free = [i for i in want if i not in label]  # a labelled row's own label counts when it is scored
    assert len(got) == len(want) and max(abs(got[i] - want[i]) for i in free) < 1e-6


def test_views_teach_only_where_they_are_sure():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    clear, blind = y[:, None] * 6 + rng.normal(size=(400, 2)), rng.normal(size=(400, 2))
    for x, teaches in ((clear, True), (blind, False)):
        view = cq._fitted(x, y).calibrated(x, y)
        may = cq._teaches(view, x, y)
        given = cq._taught(view, may, x)
        assert (may == (True, True)) == teaches and (~np.isnan(given)).any() == teaches
        assert np.nanmean(given == y) > 0.5 if teaches else True


def test_every_source_has_its_own_weight(spark):
    """Hundreds of sources, good and bad, with the same plain text."""
    rows = [(i, "plain words of a text", "en", f"source {i % 300}", 21) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 300 % 2) for i in range(1500)], "doc_id long, quality int")
    fitted = fit(docs, labels, carry=("doc_id",))
    out = {r.row.doc_id: r.quality for r in score_documents(docs, fitted, carry=["doc_id"]).collect()}
    assert all((out[i] >= 0.5) == bool(i % 300 % 2) for i in range(1500, 3000))


def test_query_separates_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    out = {r.row.doc_id: r.quality for r in score_documents(docs, fit(docs, half), carry=["doc_id"]).collect()}
    held = [(out[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.95
    assert len(queries.op10_cotrain_quality(spark, d).collect()) == docs.count()


def test_nulls_repeats_one_class_and_no_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality double, c0 string"
    rows = [(i, "plain words " * random.Random(i).randint(1, 9), "en", "s", 20, 0.0, "z") for i in range(20)]
    rows += [(None, None, None, None, None, None, None), (3, rows[3][1], "en", "s", 20, 0.0, "z"), (50, "", "en", None, 0, 0.0, "z")]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = score_documents(docs, fit(docs, none)).collect()
    assert len(out) == len(rows) and {r.quality for r in out} == {0.5}
    assert out[0].row.asDict().keys() == set(docs.columns)
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (7, None), (999, 0)], "doc_id long, quality int")
    assert all(r.quality > 0.5 for r in score_documents(docs, fit(docs, one)).collect())
    two = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    scored = score_documents(docs, fit(docs, two)).collect()
    assert all(0 <= r.quality <= 1 for r in scored) and len({r.quality for r in scored if r.row.doc_id == 3}) == 1
    assert score_documents(docs.limit(0), fit(docs.limit(0), none)).collect() == []


def test_documents_are_scored_by_one_python_step(spark):
    """A task holds a worker for each: two of them broke the pipeline's memory."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fitted = cq.fit(docs, labels)
    scored = cq.score_documents(docs, fitted)
    assert scored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert scored.select("row.*").dtypes == docs.dtypes
    apart = cq.score_features(cq.feature_table(docs, ["doc_id"]), fitted)
    key = ["row.doc_id", "quality", "text_view", "meta_view"]
    assert sorted(scored.select(*key).collect()) == sorted(apart.select(*key).collect())
