"""Toxicity by nearest labelled examples.

A bounded sample of labelled documents (``PER_CLASS`` of each class, taken in
the order of a hash of the id; documented parameter) forms an index; a second
bounded sample at the natural class rate calibrates.  A document's score comes
from its ``k`` nearest examples under exact TF-IDF cosine: each votes with
cosine**POWER, and the share of toxic votes is mapped to a probability by
isotonic regression on the calibration sample.  The neighbours are kept as
evidence.

TF-IDF: features are words (see ``text_arrays``) and the first five bytes of
words longer than that; weight (1 + ln tf) * ln((1 + D) / (1 + df)), where D
and df count **all** documents of the table; the space is the whole vocabulary
of the examples: idf lowers frequent terms, none is left out.

Exact search with a block-max inverted index: examples sit in blocks of
``BLOCK``, alike ones together.  Lists of postings are added up whole and give
a floor (the k-th best sum so far); terms frequent in a block are dense rows of
it, whose largest weights bound what the block can still add, and a block that
cannot reach the floor is skipped.  The others are scored for up to
``TOGETHER`` documents at a time.

Scale: two passes over the documents (document frequencies of the index
vocabulary, then scoring), both without a shuffle of texts; the index is
bounded by the sample, whatever the table's size, and travels as a broadcast.

Defined cases: NULL text is empty; an empty text, or one that shares no term
with the index, has no neighbours and gets the share of toxic rows in the
calibration sample; no labels at all: every score is 0; labels with NULL
``toxic`` are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.text_arrays import column_bytes, slices, words

PER_CLASS = 2500
CALIBRATION = 3000
NEIGHBOURS = 100
POWER = 1.0
HEAD = 5
BLOCK = 64
FREQUENT, OFTEN = 16, 4
GROUPS, ROUNDS = 16, 6
TOGETHER = 128
CHUNK = 1 << 13
SLICE_BYTES = 1 << 20
_U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, and of the 5-byte beginning of every
    longer word."""
    whole, ends, heads, head_docs = words(data, offsets, HEAD)
    return np.concatenate((np.repeat(np.arange(len(ends) - 1), np.diff(ends)), head_docs)), np.concatenate((whole, heads))


def term_counts(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), ordered; only terms of the sorted vocabulary."""
    if not len(vocabulary) or not len(data):
        return (np.zeros(0, np.int64),) * 3
    doc, feature = tokens(data, offsets)
    at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
    known = vocabulary[at] == feature
    pair, count = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), count


class TermIndex:
    """Inverted index over weighted, normalised examples with block maxima.

    Postings of a term (of at least one in ``FREQUENT`` examples) in a block
    that holds it at least ``OFTEN`` times are a dense row of the block, so that a block is scored for many
    documents by one matrix product; the others are lists.  The rows fill at
    most ``BLOCK / OFTEN`` times the space of their postings."""

    def __init__(self, doc, term, count, n: int, vocabulary: np.ndarray, idf: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        self.vocabulary, self.idf, self.labels, self.ids, self.n = vocabulary, idf, labels, ids, n
        self.blocks = n // BLOCK + 1
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weight**2, n))
        weight = weight / np.where(norm[doc] > 0, norm[doc], 1)
        order = np.lexsort((doc, term))
        example, weight, term = doc[order].astype(np.int32), weight[order], term[order].astype(np.int32)
        del order, doc
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(example // BLOCK, prepend=-1) != 0))
        size = np.diff(first, append=len(term))  # postings of each (term, block)
        often = np.repeat(size >= OFTEN, size) & (np.bincount(term, minlength=len(vocabulary)) * FREQUENT >= n)[term]
        self.term_start = np.searchsorted(term[~often], np.arange(len(vocabulary) + 1))  # list of each term
        self.example, self.weight = example[~often], weight[~often]
        terms = np.unique(term[often])
        self.column = np.full(len(vocabulary), -1, np.int32)  # of each term with dense rows
        self.column[terms] = np.arange(len(terms))
        self.largest = np.zeros((len(terms), self.blocks))  # weight per term and block
        at, self.rows = self.column[term[often]], []  # per block: its terms' columns, weights (term, example)
        np.maximum.at(self.largest, (at, example[often] // BLOCK), weight[often])
        order = np.argsort(example[often] // BLOCK, kind="stable")
        ends = np.searchsorted((example[often] // BLOCK)[order], np.arange(1, self.blocks))
        for some in np.split(order, ends):
            columns, row = np.unique(at[some], return_inverse=True)
            rows = np.zeros((len(columns), BLOCK))
            rows[row, example[often][some] % BLOCK] = weight[often][some]
            self.rows.append((columns, rows))

    @staticmethod
    def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all ranges one after the other, and the ranges' sizes."""
        size = end - start
        first = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(start - first, size), size

    def query(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, normalised weights) of a document."""
        weight = (1 + np.log(count)) * self.idf[term]
        norm = np.sqrt((weight**2).sum())
        return (term, weight / norm) if norm > 0 else (term[:0], weight[:0])

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_all`` of one document."""
        return self.nearest_all([(term, weight)], k)[0]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document the k examples of largest cosine (above 0) and the
        cosines, to 12 places; ties go to the smaller position in the index.

        The lists are added up first: the k-th best sum is a floor.  A block
        whose best sum and block maxima of the dense rows cannot reach it is
        left out; the most promising ones go first and lift the floor."""
        score = np.zeros((len(queries), self.blocks * BLOCK))
        often = np.zeros((len(queries), len(self.largest)))
        for i, (term, weight) in enumerate(queries):
            column = self.column[term]
            often[i, column[column >= 0]] = weight[column >= 0]
            posting, size = self._spread(self.term_start[term], self.term_start[term + 1])
            score[i] = np.bincount(self.example[posting], np.repeat(weight, size) * self.weight[posting], score.shape[1])
        bound = score.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + often @ self.largest
        first = np.zeros(bound.shape, bool)
        best = min(k // BLOCK + 2, self.blocks)
        np.put_along_axis(first, np.argpartition(-bound, best - 1, axis=1)[:, :best], True, axis=1)
        for chosen in (first, ~first):
            floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.zeros(len(queries))
            chosen &= (bound > 0) & (bound * (1 + 1e-9) >= floor[:, None])
            for block in np.flatnonzero(chosen.any(axis=0)):
                some, (columns, rows) = np.flatnonzero(chosen[:, block]), self.rows[block]
                score[some, block * BLOCK : (block + 1) * BLOCK] += often[np.ix_(some, columns)] @ rows
        score = np.round(score, 12)
        return [self._best(s, k) for s in score]

    @staticmethod
    def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(score, -k)[-k] if len(score) > k else 0.0
        found = np.flatnonzero((score > 0) & (score >= least))
        found = found[np.lexsort((found, -score[found]))[:k]]
        return found, score[found]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes; nan without neighbours."""
        weight = cosine**POWER
        return float((weight * self.labels[found]).sum() / weight.sum()) if len(found) and weight.sum() > 0 else float("nan")


def alike(doc: np.ndarray, term: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """A group of ``GROUPS`` for each example, by spherical k-means over the
    terms of at least one example in 16; it orders the index and changes no
    result."""
    often = np.bincount(term, minlength=len(idf)) * 16 >= n
    use = often[term]
    place = np.zeros((n, int(often.sum())), np.float32)
    place[doc[use], (np.cumsum(often) - 1)[term[use]]] = idf[term[use]]
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
    centre = place[np.linspace(0, n - 1, min(GROUPS, n)).astype(int)]
    for _ in range(ROUNDS):
        group = np.argmax(place @ centre.T, axis=1)
        centre = np.stack([place[group == g].sum(axis=0) if (group == g).any() else c for g, c in enumerate(centre)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return group


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares map of x to y (pool adjacent
    violators), a little smoothed towards the mean so that no score is 0 or 1."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, smallest and largest x
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, top = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = top
    mean = float(y.mean())
    fit = [(s + mean) / (n + 1) for s, n, _, _ in blocks]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    values = np.maximum.accumulate(np.repeat(fit, 2))
    return knots, values


class ToxicityModel:
    def __init__(self, index: TermIndex | None, knots: np.ndarray, values: np.ndarray, base: float):
        self.index, self.knots, self.values, self.base = index, knots, values, base

    def score(self, vote: np.ndarray) -> np.ndarray:
        out = np.interp(vote, self.knots, self.values) if len(self.knots) else np.full(len(vote), self.base)
        return np.clip(np.where(np.isnan(vote), self.base, out), 0.0, 1.0)


def _votes(index: TermIndex, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    doc, term, count = term_counts(index.vocabulary, *column_bytes(batch.column("text")))
    at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    for first in range(0, batch.num_rows, TOGETHER):
        ends = at[first : first + TOGETHER + 1]
        for found, cosine in index.nearest_all([index.query(term[a:b], count[a:b]) for a, b in zip(ends[:-1], ends[1:])], NEIGHBOURS):
            yield found, cosine, index.vote(found, cosine)


def _sample(labels: DataFrame, n: int, salt: int) -> list[int]:
    """The first ``n`` ids in the order of a hash."""
    return [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n).collect()]


def _texts(docs: DataFrame, ids: list[int]) -> pa.RecordBatch:
    """Texts of a bounded sample, one per id, in id order."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    table = docs.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()
    return table.sort_by("doc_id").combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pydict({"doc_id": [], "text": []})


def _document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents of the whole table each feature occurs, and how
    many documents there are."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "n long, chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = wanted.value, np.zeros(len(wanted.value), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                total += np.bincount(term_counts(known, *column_bytes(part.column("text")))[1], minlength=len(known))
                n += part.num_rows
        for chunk, at in enumerate(range(0, len(total), CHUNK)):
            counts = pa.array([total[at : at + CHUNK].astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([chunk], pa.int32()), counts], ["n", "chunk", "counts"])

    def add(group):
        import pandas as pd

        total = sum(np.frombuffer(c, "<i8") for c in group["counts"])
        return pd.DataFrame({"n": [int(group["n"].sum())], "chunk": group["chunk"][:1], "counts": [total.tobytes()]})

    # a task sends its counts in chunks, added in two steps; the driver takes one vector
    some = docs.select("text").mapInArrow(count, schema)
    some = some.withColumn("part", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(64)).cast("int"))
    rows = some.groupBy("chunk", "part").applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    counts = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    return counts, max((r["n"] for r in rows), default=0)


def _example_features(batch: pa.RecordBatch, wanted: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features of each wanted row, slice by slice."""
    at = 0
    for part in slices(batch, "text", SLICE_BYTES):
        doc, feature = tokens(*column_bytes(part.column("text")))
        use = wanted[at + doc]
        doc, feature = doc[use], feature[use]
        order = np.lexsort((feature, doc))
        doc, feature = doc[order], feature[order]
        yield feature[np.concatenate(([True], (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])))[: len(doc)]]
        at += part.num_rows


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from ``labels`` (id, label 0/1); their texts are in ``docs``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    labels = (
        labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = {c: _sample(labels.where(F.col("label") == c), PER_CLASS, 11) for c in (0, 1)}
    label_of = {i: c for c, ids in chosen.items() for i in ids}
    spread = {r["doc_id"]: r["label"] for r in labels.orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(CALIBRATION).collect()}
    base = float(np.mean(list(spread.values()))) if spread else 0.0
    empty = ToxicityModel(None, np.zeros(0), np.zeros(0), base)
    batch = _texts(docs, sorted({*label_of, *spread}))
    if not batch.num_rows:
        return empty
    ids = np.array(batch.column("doc_id").to_pylist())
    in_index = np.isin(ids, list(label_of))
    vocabulary = np.unique(np.concatenate([np.zeros(0, _U), *_example_features(batch, in_index)]))
    if not len(vocabulary):
        return empty
    df, total = _document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + df))
    some, at = [], 0
    for part in slices(batch, "text", SLICE_BYTES):
        d, t, c = term_counts(vocabulary, *column_bytes(part.column("text")))
        some.append([x.astype(np.int32) for x in (d + at, t, c)])
        at += part.num_rows
    doc, term, count = (np.concatenate(c) for c in zip(*some))
    del some
    use, number = in_index[doc], (np.cumsum(in_index) - 1).astype(np.int32)
    of, terms, counts = number[doc[use]], term[use], count[use]
    mine = ids[in_index]
    # alike examples (in words, label and size) share blocks, which tightens the bounds
    size = np.bincount(of, minlength=len(mine))
    rank = np.empty(len(mine), np.int32)
    rank[np.lexsort((size, [label_of[i] for i in mine], alike(of, terms, idf, len(mine))))] = np.arange(len(mine))
    ordered = np.empty_like(mine)
    ordered[rank] = mine
    index = TermIndex(rank[of], terms, counts, len(mine), vocabulary, idf, np.array([label_of[i] for i in ordered], float), ordered)
    del use, of, terms, counts
    votes, truth = [], []
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    asked = [row for row, i in enumerate(ids.tolist()) if i in spread]
    for first in range(0, len(asked), TOGETHER):
        some = asked[first : first + TOGETHER]
        nearest = index.nearest_all([index.query(term[at[r] : at[r + 1]], count[at[r] : at[r + 1]]) for r in some], NEIGHBOURS + 1)
        for i, (found, cosine) in zip(ids[some].tolist(), nearest):
            other = index.ids[found] != i  # an example does not vote on itself
            vote = index.vote(found[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS])
            if vote == vote:
                votes.append(vote)
                truth.append(spread[i])
    if not votes:
        return empty
    return ToxicityModel(index, *isotonic(np.array(votes), np.array(truth, float)), base)


def score_documents(docs: DataFrame, model: ToxicityModel, evidence: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score[, neighbours, cosines, neighbour_labels]) per document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", *(["neighbours", "cosines", "neighbour_labels"] if evidence else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                none = (np.zeros(0, np.int64), np.zeros(0), float("nan"))
                found = list(_votes(model.index, part)) if model.index else [none] * part.num_rows
                columns = [part.column("doc_id"), pa.array(model.score(np.array([v for _, _, v in found])))]
                if evidence:
                    ids = model.index.ids if model.index else np.zeros(0, np.int64)
                    labels = model.index.labels.astype(np.int32) if model.index else np.zeros(0, np.int32)
                    columns += [
                        pa.array([ids[f] for f, _, _ in found], pa.list_(pa.int64())),
                        pa.array([c for _, c, _ in found], pa.list_(pa.float64())),
                        pa.array([labels[f] for f, _, _ in found], pa.list_(pa.int32())),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", neighbours array<long>, cosines array<double>, neighbour_labels array<int>" if evidence else ""
    return source.mapInArrow(run, f"doc_id {key_type}, score double{more}")
