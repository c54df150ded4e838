from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.llm import multi_index, queries
from churnscope.llm.multi_index import Codebooks, nearest_neighbours


def brute(rows, is_query, k):
    out = {}
    for q, v in rows:
        if is_query(q):
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_cells_come_by_falling_sum():
    rng = np.random.default_rng(2)
    books = Codebooks(rng.normal(size=(200, 6)), 7)
    q = rng.normal(size=6)
    walked = list(books.walk(q))
    sums = [books.first[c // 7] @ q[:3] + books.second[c % 7] @ q[3:] for c in walked]
    assert sorted(walked) == list(range(49)) and (np.diff(sums) <= 1e-12).all()


@pytest.mark.parametrize("part_rows,merge", [(64, 2), (8192, 64)])
def test_recall_ties_hot_vector_and_bad_vectors(spark, monkeypatch, part_rows, merge):
    monkeypatch.setattr(multi_index, "PART_ROWS", part_rows)
    monkeypatch.setattr(multi_index, "MERGE", merge)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (2005, [float("inf")] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as cell", "3 as rank")
    got = nearest_neighbours(frame, F.col("id") % 20 == 0, k=10).collect()
    want = brute([(i, np.array(v)) for i, v in rows], lambda q: q % 20 == 0, 10)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    assert set(by) == set(want) and all(sorted(v) == list(range(1, 11)) for v in by.values())
    hits = sum(len({i for i, _ in by[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q in (1000, 1020):  # all copies tie: the smallest ids win
        if abs(want[q][0][1] - want[q][-1][1]) < 1e-9:
            assert [by[q][r][0] for r in range(1, 11)] == [i for i, _ in want[q]]
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for q in by for i, s in by[q].values())


def test_few_candidates_and_empty_table(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id) for r in nearest_neighbours(frame, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (0, 3, 3), (20, 1, 0), (20, 2, 3), (20, 3, 3)]
    assert nearest_neighbours(frame.limit(0), F.col("id") % 20 == 0).collect() == []


def test_query_recall_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, lambda q: q % 20 == 0, 20)
    got = {}
    for r in queries.op6_multi_index(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert set(got) == set(want) and recall >= 0.9
