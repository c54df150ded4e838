"""Nearest neighbours with an inverted multi-index.

Vectors are split into two halves, each quantised by its own codebook; a pair
of centroids is a cell, and every vector is listed in its cell.  A query walks
the cells in the order of the summed nearness of its halves to the two
centroids, with a heap over the two sorted centroid lists, until the cells
hold enough vectors; those are reranked by the exact measure on the original
vectors.  Nearness is the inner product in double precision.

How many vectors a query visits is a share of the table, chosen so that the
search reaches ``RECALL`` on a bounded sample compared with brute force (it
depends on how clustered the vectors are: 2 % may do, or half of them).

Scale: codebooks are fitted on ``SAMPLE`` vectors (documented bound), all
vectors are indexed.  Rows of neighbouring cells are packed into parts of at
most ``PART_ROWS`` vectors; a cell larger than that, be it one vector's copies,
spans several parts.  Queries travel in blocks of ``QUERY_BLOCK`` with their
visited cells, and only to parts that hold one of those; a part answers with
its best ``k`` per query, and a query's answers are merged in rounds of a
bounded number of parts.

Defined cases: vectors that are NULL, all zero, or hold NULL or non-finite
components take no part, neither do those of another length than most; a NULL
id takes no part; rows with the same id are separate candidates, but none of
them answers a query of that id; fewer candidates than ``k``: all are
returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.storage import stored

SAMPLE = 20_000
RECALL = 0.97
CHECKED = 200
MAX_CENTROIDS = 256
PART_ROWS = 2048
QUERY_BLOCK = 256
MERGE = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else -1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    centroids = np.unique(x, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:k]]
    for _ in range(12):
        near = _nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


class Codebooks:
    """Two codebooks, how many vectors each cell holds, and how many a query
    visits.  Cells are numbered first * len(second) + second."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = max(1, sample.shape[1] // 2)
        self.first = _codebook(sample[:, : self.half], centroids, 1)
        self.second = _codebook(sample[:, self.half :], centroids, 2)
        self.counts = np.zeros(len(self.first) * len(self.second), np.int64)
        self.visit = 0

    def cells(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, np.int64)
        return _nearest(x[:, : self.half], self.first) * len(self.second) + _nearest(x[:, self.half :], self.second)

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Non-empty cells by falling summed inner product with the centroids."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b, wide = a[by_a].tolist(), b[by_b].tolist(), len(self.second)
        by_a, by_b = by_a.tolist(), by_b.tolist()
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i] * wide + by_b[j]
            # (i, j) opens (i, j + 1); the first of a row also opens the next row
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def visited(self, query: np.ndarray, enough: int) -> np.ndarray:
        """A flag per cell: those walked until they hold ``enough`` vectors."""
        out, held = np.zeros(len(self.counts), bool), 0
        for cell in self.walk(query):
            if self.counts[cell]:
                out[cell] = True
                held += int(self.counts[cell])
                if held >= enough:
                    break
        return out


def _share(books: Codebooks, x: np.ndarray, k: int) -> float:
    """The smallest tried share of the sample ``x`` to visit for RECALL."""
    if len(x) <= 4 * k:
        return 1.0
    sampled = Codebooks.__new__(Codebooks)
    sampled.__dict__ = dict(books.__dict__)
    cells = books.cells(x)
    sampled.counts = np.bincount(cells, minlength=len(books.counts))
    asked = np.linspace(0, len(x) - 1, min(CHECKED, len(x))).astype(int)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, k, axis=1)[:, :k]
    order = np.full((len(asked), len(books.counts)), np.inf)  # vectors visited before each cell
    for row, q in enumerate(asked):
        held = 0
        for cell in sampled.walk(x[q]):
            order[row, cell] = held
            held += int(sampled.counts[cell])
    before = np.sort(order[np.arange(len(asked))[:, None], cells[best]].ravel()) / len(x)
    return min(1.0, float(before[int(np.ceil(RECALL * len(before))) - 1]) * 1.1 + k / len(x) + 0.005)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= floor)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]


def _answer(books_visit: np.ndarray, q_ids, queries, ids, x, cells, k) -> list[tuple[int, bytes, bytes]]:
    """Best k of a part for each query of a block that visits one of its cells."""
    rough = queries @ x.T
    out = []
    for row, q in enumerate(q_ids.tolist()):
        use = books_visit[row][cells] & (ids != q)
        if not use.any():
            continue
        at = np.flatnonzero(use)
        value = rough[row, at]
        if len(at) > k:  # near the k-th by the blocked product: let the exact one decide
            floor = np.partition(value, len(at) - k)[len(at) - k]
            at = at[value >= floor - 1e-9 * (1 + abs(floor))]
        exact = (x[at] * queries[row]).sum(axis=1)
        best = _best(ids[at], exact, k)
        out.append((q, ids[at][best].tobytes(), exact[best].tobytes()))
    return out


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of each row for which
    ``is_query`` (over the column ``id``) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    sample_rows = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not sample_rows:
        return empty
    sample = np.array([r["vector"] for r in sample_rows], float)
    books = Codebooks(sample, int(min(MAX_CENTROIDS, max(4, (total / 16) ** 0.5), len(sample))))
    books.visit = int(np.ceil(_share(books, sample, k) * total))
    sent = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sent.value.cells(x).astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary())],
                ["id", "cell", "raw"],
            )

    listed = stored(rows.mapInArrow(place, "id long, cell int, raw binary"), "multi-index")
    counts = {r["cell"]: r["count"] for r in listed.groupBy("cell").count().collect()}  # MAX_CENTROIDS**2 rows at most
    books.counts[list(counts)] = list(counts.values())
    # parts: runs of cells with about PART_ROWS vectors; a larger cell has several
    first, copies, part, room = np.zeros(len(books.counts), np.int64), np.ones(len(books.counts), np.int64), 0, PART_ROWS
    for cell in np.flatnonzero(books.counts).tolist():
        n = int(books.counts[cell])
        if n > room:
            part, room = part + (room < PART_ROWS), PART_ROWS
        first[cell] = part
        if n > PART_ROWS:
            copies[cell] = -(-n // PART_ROWS)
            part, room = part + int(copies[cell]), PART_ROWS
        else:
            room -= n
    parts = part + 1
    sent = spark.sparkContext.broadcast((books, first, copies))

    def to_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, copies = sent.value
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            part = first[cell] + (ids * 0x9E3779B1 % (1 << 31)) % copies[cell]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[batch.column(c) for c in ("id", "cell", "raw")]], ["part", "id", "cell", "raw"])

    held = listed.mapInArrow(to_part, "part int, id long, cell int, raw binary")
    queries = listed.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def to_block(group: pd.DataFrame) -> pd.DataFrame:
        """A block of queries with their visited cells, once per part that has
        one of them."""
        books, first, copies = sent.value
        group = group.sort_values("id", kind="stable")
        x = np.stack([np.frombuffer(r) for r in group["raw"]])
        flags = np.stack([books.visited(q, books.visit) for q in x])
        used = flags.any(0)
        rows = []
        for part in np.unique(np.concatenate([first[c] + np.arange(copies[c]) for c in np.flatnonzero(used).tolist()])).tolist():
            cells = np.flatnonzero(used & (first <= part) & (part < first + copies))
            low, high = int(cells[0]), int(cells[-1]) + 1
            rows.append((part, int(group["block"].iloc[0]), group["id"].to_numpy().tobytes(), x.tobytes(), low, np.packbits(flags[:, low:high], axis=1).tobytes()))
        return pd.DataFrame(rows, columns=["part", "block", "q_ids", "q_raw", "low", "flags"])

    # near queries share a block: they visit the same cells
    order = Window.partitionBy("lane").orderBy("cell", "id")
    lanes = max(8, blocks // 8)
    asked = (
        queries.withColumn("lane", F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int"))
        .withColumn("block", F.floor((F.row_number().over(order) - 1) / F.lit(QUERY_BLOCK)).cast("int") * F.lit(lanes) + F.col("lane"))
        .groupBy("block")
        .applyInPandas(to_block, "part int, block int, q_ids binary, q_raw binary, low int, flags binary")
    )

    def search(_: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        books = sent.value[0]
        out: list[tuple] = []
        if len(held) and len(asked):
            ids, cells = held["id"].to_numpy(), held["cell"].to_numpy()
            x = np.stack([np.frombuffer(r) for r in held["raw"]])
            part = int(held["part"].iloc[0])
            for r in asked.itertuples():
                q_ids = np.frombuffer(r.q_ids, np.int64)
                some = np.unpackbits(np.frombuffer(r.flags, np.uint8).reshape(len(q_ids), -1), axis=1)
                flags = np.zeros((len(q_ids), len(books.counts)), bool)
                flags[:, r.low : r.low + some.shape[1]] = some[:, : len(books.counts) - r.low]
                found = _answer(flags, q_ids, np.frombuffer(r.q_raw).reshape(len(q_ids), -1), ids, x, cells, k)
                out += [(part, r.block, q, i, s) for q, i, s in found]
        return pd.DataFrame(out, columns=["part", "block", "query_id", "ids", "scores"])

    answers = (
        held.groupBy("part").cogroup(asked.groupBy("part"))
        .applyInPandas(search, "part int, block int, query_id long, ids binary, scores binary")
    )

    def merged(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, some in group.groupby("query_id", sort=True):
            ids = np.concatenate([np.frombuffer(v, np.int64) for v in some["ids"]])
            scores = np.concatenate([np.frombuffer(v) for v in some["scores"]])
            best = _best(ids, scores, k)
            yield int(q), ids[best], scores[best]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(group["part"].iloc[0]) // MERGE, int(group["block"].iloc[0]), q, i.tobytes(), s.tobytes()) for q, i, s in merged(group)]
        return pd.DataFrame(rows, columns=["part", "block", "query_id", "ids", "scores"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(q, rank, i, s) for q, ids, scores in merged(group) for rank, (i, s) in enumerate(zip(ids.tolist(), scores.tolist()), 1)]
        return pd.DataFrame(rows, columns=["query_id", "rank", "id", "score"])

    while parts > MERGE:
        fields = "part int, block int, query_id long, ids binary, scores binary"
        answers = answers.groupBy("block", F.floor(F.col("part") / MERGE).alias("to")).applyInPandas(merge, fields)
        parts = -(-parts // MERGE)
    return answers.groupBy("block").applyInPandas(finish, "query_id long, rank int, id long, score double")
