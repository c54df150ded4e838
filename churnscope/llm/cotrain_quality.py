"""Quality classification by co-training of two views.

View 1 sees the text only (byte and word statistics, a logistic regression),
view 2 the page metadata only (language, source, length: for each value the
evidence of the labels seen with it, weighed by a logistic regression).  Both
start from labelled documents.  In each round every view labels all unlabelled
documents of which it is sure, and the other one learns from them: view 2 counts
them per source, language and length; view 1 takes Newton steps whose gradients
and Hessians are summed over all of them.  A view may teach a label only where
its calibrated probability is beyond ``SURE`` and where the labelled documents
kept aside confirm that precision, so a view that knows nothing teaches nothing.
Platt scaling calibrates each view, and a last logistic regression over both
calibrated log-odds combines them.

Scale: the features of all documents are computed once and written (about 300
bytes each); a round is a few aggregations over them, of which the driver sees
one matrix.  Metadata evidence is a table with a row per value, joined, so every
source has its own weight however many there are.  ``LABELLED`` bounds the
labelled documents used (in the order of a hash of the id); the unlabelled ones
are all used, and count together at most as much as the labelled ones.

Defined cases: NULL text is empty, NULL metadata is a value of its own, and a
value never seen with a label is no evidence; labels with NULL quality or unknown
ids are not used; without labels every document scores 0.5, and is kept; with
labels of one class only, every score is that class's smoothed share; repeated
rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.llm.storage import stored
from churnscope.llm.text_arrays import column_bytes, slices, words

LABELLED = 8000
ROUNDS = 4
STEPS = 2  # Newton steps of the text view in a round
SURE = 0.95
PSEUDO = 0.5  # weight of a pseudo-label, as long as there are few
RIDGE = 3.0
SLICE_BYTES = 1 << 20
KEEP = 0.5

_CLASS = np.zeros(256, np.int64)  # upper, lower, digit, space, line end, stop, mark, beyond ASCII, other
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (
        7 if _i > 127 else 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if "0" <= _c <= "9" else 4 if _c == "\n"
        else 3 if _c in " \t\r\v\f" else 5 if _c in ".,;:" else 6 if 32 < _i < 127 else 8
    )
_MARKS = np.array([i for i in range(256) if _CLASS[i] in (5, 6)])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document: shares of byte classes and of single marks, word
    length, repetition of words, of neighbours and of lines."""
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    by_byte = np.bincount(doc * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    classes = np.zeros((n, 9))
    for c in range(9):
        classes[:, c] = by_byte[:, _CLASS == c].sum(1)
    hashes, ends = words(data, offsets)
    n_words = np.diff(ends)
    some = np.maximum(n_words, 1).astype(float)
    owner = np.repeat(np.arange(n), n_words)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(first), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs)
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    same = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # words with one before them in the document
    pair = np.stack((owner[same].astype(np.uint64), hashes[same] ^ (hashes[same - 1] << np.uint64(1))))
    pairs = np.bincount(np.unique(pair, axis=1)[0].astype(np.int64), minlength=n) if len(same) else np.zeros(n)
    distinct = np.bincount(o[first], minlength=n)
    shares = classes / size[:, None]
    lengths = np.diff(offsets) / some
    return np.column_stack(
        [
            shares, np.sqrt(shares), np.sqrt(by_byte[:, _MARKS] / size[:, None]), np.log1p(lengths), np.log1p(np.diff(offsets)),
            distinct / some, most / some, np.bincount(owner[twin], minlength=n) / some, pairs / some,
            np.log1p(some) * (1 - distinct / some), classes[:, 0] / np.maximum(classes[:, 0] + classes[:, 1], 1), n_words == 0,
        ]
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(w: np.ndarray, slope: np.ndarray, curve: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """One damped step from summed gradients and Hessians; the last coefficient
    is the intercept."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    step = np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)
    return w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9)), float(np.abs(step).max())


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-loss of rows ``x`` (with a last column 1)."""
    p = _sigmoid(x @ w)
    return x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression in memory."""
    x = _ones(x)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        w, moved = _newton(w, *_sums(x, y, w), ridge)
        if moved < 1e-6:
            break
    return w


@dataclass(frozen=True)
class View:
    """A logistic regression over standardised features, with Platt scaling."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        return _ones(np.clip((x - self.mean) / self.scale, -12, 12))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.platt[0] * (self.standard(x) @ self.weights) + self.platt[1], -30, 30)

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        return replace(self, platt=_logistic((self.standard(x) @ self.weights)[:, None], y, 1e-2))


def _fitted(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    view = View(mean, np.where(scale > 1e-9, scale, np.inf), np.zeros(0), np.array([1.0, 0.0]))
    return replace(view, weights=_logistic(view.standard(x)[:, :-1], y, RIDGE))


def _teaches(view: View, x: np.ndarray, y: np.ndarray) -> tuple[bool, bool]:
    """May the view teach label 0, label 1?  Judged on the rows kept aside."""
    p = _sigmoid(view.log_odds(x))
    return tuple(
        bool(sure.sum() >= 20 and (y[sure] == label).mean() >= SURE - 0.02) for label, sure in ((0, p <= 1 - SURE), (1, p >= SURE))
    )


def _taught(view: View, may: tuple[bool, bool], x: np.ndarray) -> np.ndarray:
    """Pseudo-labels; NaN where the view is not sure or may not teach."""
    p = _sigmoid(view.log_odds(x))
    return np.where((p >= SURE) & may[1], 1.0, np.where((p <= 1 - SURE) & may[0], 0.0, np.nan))


def _evidence(positive: np.ndarray, negative: np.ndarray, base: float) -> np.ndarray:
    """Log-odds of the labels seen with a value, against those of all."""
    return np.log((positive + 2 * base) / (negative + 2 * (1 - base))) - np.log(base / (1 - base))


@dataclass(frozen=True)
class QualityModel:
    text: View | None
    meta: View | None
    combine: np.ndarray
    base: float
    taught: tuple[tuple[int, int], ...] = ()  # pseudo-labels that (text, meta) gave, by round

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined probability and those of the two views."""
        if self.text is None:
            same = np.full(len(text), self.base)
            return same, same, same
        odds = [self.text.log_odds(text), self.meta.log_odds(meta)]
        return _sigmoid(_ones(np.column_stack(odds)) @ self.combine), _sigmoid(odds[0]), _sigmoid(odds[1])


@dataclass(frozen=True)
class Fitted:
    """A model, the table of metadata evidence it reads, and the features of the
    documents it was fitted on."""

    model: QualityModel
    evidence: DataFrame  # kind, value, positive, negative
    features: DataFrame


KINDS = ["source", "lang", "length"]
_META = [f"{kind}_{side}" for kind in KINDS for side in ("positive", "negative")]


def _sources(docs: DataFrame, carry: list[str], id_col: str, text_col: str, lang_col: str, source_col: str, length_col: str) -> tuple[DataFrame, list[str], Column]:
    """Text and metadata values of the documents, the columns that go along
    with them, and ``row`` made of these."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    length = F.col(length_col).cast("double")
    rest = [F.col(f"`{c}`") for c in carry if c != text_col] or [F.lit(0).alias("none")]
    source = docs.select(
        F.struct(*rest).alias("rest"), F.col(id_col).cast("bigint").alias("id"), value(F.col(source_col)).alias("source"),
        value(F.col(lang_col)).alias("lang"), value(F.floor(F.log2(F.greatest(length, F.lit(0.0)) + 1))).alias("length"),
        F.col(text_col).cast("string").alias("text"),
    )
    row = [F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in carry]
    return source, ["rest", *(["text"] if text_col in carry else [])], (F.struct(*row) if row else F.lit(None)).alias("row")


def _views(part: pa.RecordBatch) -> np.ndarray:
    """The text features as 32-bit numbers."""
    return text_features(*column_bytes(part.column("text"))).astype("<f4")


def feature_table(
    docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", length_col: str = "n_chars",
) -> DataFrame:
    """``row`` (the columns ``carry``), ``id``, the metadata values as strings
    (``source``, ``lang``, ``length``: a power of two) and ``view``, the text
    features as 32-bit numbers."""
    source, along, row = _sources(docs, carry, id_col, text_col, lang_col, source_col, length_col)
    kept = [*along, "id", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                view = pa.array([r.tobytes() for r in _views(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], view], [*kept, "view"])

    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField("view", T.BinaryType())])
    return source.mapInArrow(run, schema).select(row, "id", *KINDS, "view")


def _text_of(batch: pa.RecordBatch) -> np.ndarray:
    raw = b"".join(batch.column("view").to_pylist())
    return np.frombuffer(raw, "<f4").reshape(batch.num_rows, -1).astype(float)


def _meta_of(batch: pa.RecordBatch, base: float) -> np.ndarray:
    counts = [batch.column(c).to_numpy(zero_copy_only=False) for c in _META]
    return np.column_stack([_evidence(p, n, base) for p, n in zip(counts[::2], counts[1::2])])


def _with_evidence(table: DataFrame, evidence: DataFrame) -> DataFrame:
    """``table`` with the label counts of its metadata values (0: not seen)."""
    for kind in KINDS:
        own = evidence.where(F.col("kind") == kind).select(
            F.col("value").alias("_value"), F.col("positive").alias(f"{kind}_positive"), F.col("negative").alias(f"{kind}_negative")
        )
        table = table.join(own, F.col(kind) == F.col("_value"), "left").drop("_value")
    return table.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in _META})


def _label_counts(table: DataFrame, view: View, may: tuple[bool, bool]) -> DataFrame:
    """(kind, value, positive, negative): pseudo-labels of the text view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = _taught(view, may, _text_of(batch))
                known = pa.array(~np.isnan(given))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in KINDS], pa.array(given)], [*KINDS, "given"]).filter(known)

    schema = ", ".join(f"{kind} string" for kind in KINDS) + ", given double"
    found = table.select(*KINDS, "view").mapInArrow(run, schema)
    values = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in KINDS]))
    found = found.groupBy(*KINDS).agg(F.sum("given").alias("p"), F.sum(1 - F.col("given")).alias("q")).select(values.alias("v"), "p", "q")
    return found.groupBy("v.kind", "v.value").agg(F.sum("p").alias("positive"), F.sum("q").alias("negative"))


def _gradients(table: DataFrame, base: float, teacher: View, may: tuple[bool, bool], view: View) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient, Hessian and number of the pseudo-labels that the metadata view
    gives, for the text view: summed in the tasks, then by Spark."""
    k = len(view.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            given = _taught(teacher, may, _meta_of(batch, base))
            known = ~np.isnan(given)
            slope, curve = _sums(view.standard(_text_of(batch)[known]), given[known], view.weights)
            total += np.concatenate((curve.ravel(), slope, [known.sum()]))
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = table.select(*_META, "view").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * k + k + 1)
    for r in sums:
        total[r["i"]] = r["v"]
    return total[k * k : -1], total[: k * k].reshape(k, k), int(total[-1])


def _weight(given: float, labelled: int) -> float:
    """Of one pseudo-label: together they count no more than the labels."""
    return min(PSEUDO, labelled / given) if given else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", length_col: str = "n_chars", label_col: str = "quality", carry: tuple[str, ...] = (),
) -> Fitted:
    """Learns from ``labels`` (id, label 0/1) and from all of ``docs``.  The
    features it keeps carry the columns ``carry``."""
    spark = docs.sparkSession
    table = stored(feature_table(docs, list(carry) or [id_col], id_col, text_col, lang_col, source_col, length_col), "quality-features")
    labels = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    label = {r["id"]: r["label"] for r in labels.orderBy(F.xxhash64("id", F.lit(41)), "id").limit(LABELLED).collect()}
    known = spark.createDataFrame([(i,) for i in label], "id long")
    # at most LABELLED ids
    rows = table.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct("view", *KINDS)).alias("r")).select("id", "r.*").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    y = np.array([label[r["id"]] for r in rows], float)
    nothing = spark.createDataFrame([], "kind string, value string, positive double, negative double")
    if not len(y) or y.min() == y.max():
        return Fitted(QualityModel(None, None, np.zeros(0), float((y.sum() + 0.5) / (len(y) + 1))), nothing, table)
    text = np.stack([np.frombuffer(r["view"], "<f4") for r in rows]).astype(float)
    aside = np.arange(len(y)) % 4 == 3  # for calibration
    if not (len(set(y[aside])) > 1 and len(set(y[~aside])) > 1):
        aside = np.zeros(len(y), bool)
    check, learn = aside if aside.any() else ~aside, ~aside
    base = float(y[learn].mean())
    free = table.join(F.broadcast(known), "id", "left_anti")

    own: dict[tuple[str, str], list[float]] = {}
    for r, one, used in zip(rows, y, learn):
        for kind in KINDS:
            if used:
                pair = own.setdefault((kind, r[kind]), [0.0, 0.0])
                pair[0], pair[1] = pair[0] + one, pair[1] + 1 - one
    own_counts = spark.createDataFrame([(*k, float(p), float(q)) for k, (p, q) in own.items()], nothing.schema)

    def evidence_of(pseudo: DataFrame | None) -> DataFrame:
        if pseudo is None:
            return own_counts
        given = pseudo.where("kind = 'lang'").agg(F.sum(F.col("positive") + F.col("negative"))).first()[0] or 0.0
        weight = F.lit(_weight(given, int(learn.sum())))
        both = own_counts.unionByName(pseudo.withColumns({c: F.col(c) * weight for c in ("positive", "negative")}))
        return stored(both.groupBy("kind", "value").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative")), "quality-evidence")

    def meta_view(evidence: DataFrame) -> tuple[View, np.ndarray]:
        """Fitted on the labelled rows, whose own label is not evidence."""
        asked = spark.createDataFrame(sorted({(kind, r[kind]) for r in rows for kind in KINDS}), "kind string, value string")
        seen = {(r["kind"], r["value"]): (r["positive"], r["negative"]) for r in evidence.join(F.broadcast(asked), ["kind", "value"]).collect()}
        counts = np.array([[seen.get((kind, r[kind]), (0.0, 0.0)) for kind in KINDS] for r in rows])
        less = np.where(learn, 1.0, 0.0)[:, None]
        x = _evidence(np.maximum(counts[:, :, 0] - less * y[:, None], 0), np.maximum(counts[:, :, 1] - less * (1 - y[:, None]), 0), base)
        return _fitted(x[learn], y[learn]).calibrated(x[check], y[check]), x

    view = _fitted(text[learn], y[learn]).calibrated(text[check], y[check])
    evidence = evidence_of(None)
    meta, meta_x = meta_view(evidence)
    taught = []
    for _ in range(ROUNDS):
        may_text, may_meta = _teaches(view, text[check], y[check]), _teaches(meta, meta_x[check], y[check])
        new_view, counts, given = view, None, 0
        if any(may_meta):
            joined = _with_evidence(free, evidence)
            for _step in range(STEPS):
                slope, curve, given = _gradients(joined, base, meta, may_meta, new_view)
                own_slope, own_curve = _sums(view.standard(text[learn]), y[learn], new_view.weights)
                weight = _weight(given, int(learn.sum()))
                new_view = replace(new_view, weights=_newton(new_view.weights, own_slope + weight * slope, own_curve + weight * curve, RIDGE)[0])
        if any(may_text):
            counts = stored(_label_counts(free, view, may_text), "quality-labels")
            evidence = evidence_of(counts)
        sure = int(counts.where("kind = 'lang'").agg(F.sum(F.col("positive") + F.col("negative"))).first()[0] or 0) if counts is not None else 0
        taught.append((sure, given))
        if not sure and not given:
            break
        view = new_view.calibrated(text[check], y[check])
        if counts is not None:
            meta, meta_x = meta_view(evidence)
    odds = np.column_stack((view.log_odds(text[check]), meta.log_odds(meta_x[check])))
    model = QualityModel(view, meta, _logistic(odds, y[check], 0.1), base, tuple(taught))
    return Fitted(model, evidence, table)


def score_features(table: DataFrame, fitted: Fitted) -> DataFrame:
    """``row``, ``quality``, ``text_view`` and ``meta_view`` (probabilities of
    label 1) of the rows of a ``feature_table``."""
    model = fitted.model
    joined = _with_evidence(table, fitted.evidence).select("row", *_META, "view")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.scores(_text_of(batch), _meta_of(batch, model.base))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found)], ["row", "quality", "text_view", "meta_view"])

    schema = T.StructType([joined.schema["row"], *[T.StructField(n, T.DoubleType()) for n in ("quality", "text_view", "meta_view")]])
    return joined.mapInArrow(run, schema)


def score_documents(
    docs: DataFrame, fitted: Fitted, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars",
) -> DataFrame:
    """``score_features`` of any documents; ``row`` holds the columns ``carry``
    (all by default).  One pass of Python: features and scores are made together."""
    carry, model = docs.columns if carry is None else carry, fitted.model
    source, along, row = _sources(docs, carry, id_col, text_col, lang_col, source_col, length_col)
    joined = _with_evidence(source, fitted.evidence).select(*dict.fromkeys([*along, "text"]), *_META)
    names = ["quality", "text_view", "meta_view"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = model.scores(_views(part).astype(float), _meta_of(part, model.base))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in along], *map(pa.array, found)], [*along, *names])

    schema = T.StructType([source.schema[c] for c in along] + [T.StructField(n, T.DoubleType()) for n in names])
    return joined.mapInArrow(run, schema).select(row, *names)
