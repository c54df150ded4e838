"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text (lower-case A-Z; see ``text_arrays``) and one
end token.  A state of the tree is a context of one to ``DEPTH`` words.

* Candidates are all contexts and successors whose n-gram (context plus
  successor) occurs at least ``SUPPORT`` times in the training rows, whatever
  their number: the tree grows with the corpus.
* A context is retained if its next-word distribution diverges from that of
  its suffix: 2 N(s) KL(P(.|s) || P(.|suffix)) over its stored successors and
  "any other" exceeds ln N(s) per successor.
* Smoothing: P(x|s) = max(c(s,x) - D, 0) / N(s) + lambda(s) P(x|suffix), with
  lambda(s) the mass left; the root is the Witten-Bell unigram distribution
  over the *whole* vocabulary, c / (N + V) and V / (N + V) for an unknown
  word.  Every state's distribution over known words plus "unknown" sums to 1.
* A text's score is the sum of log10 P(word | longest retained suffix).

Scale.  Neither words nor n-grams ever meet in one place.  Texts are cut once
into slices of about ``FLUSH`` tokens, kept as places in the slice's own word
list.  A slice sends its distinct keys (64-bit hashes of words, n-grams or
contexts) to their ``2**b`` hash ranges, whose number grows with the input, and
each range answers every slice that asked.  Slices and answers are stored by
slice, so they are shuffled once:

1. words and bigrams get their counts in all training rows;
2. one-word contexts get lambda if they are retained, and the next longer
   n-grams (of contexts with ``SUPPORT`` occurrences) their counts; and so on
   with one more round per word of depth.

The divergence is a sum over successors, so one slice per stored n-gram, which
the n-gram's range names, adds its term, and the context's range adds these up.
Hot words, n-grams and contexts are one entry per slice.

Defined cases: NULL text is empty and still has the end token; no training
rows: V = N = 0, every token is unknown; repeated rows get equal scores;
tokens are never truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import buckets_for, keyed, stored_by, text_bytes
from churnscope.llm.text_arrays import (
    END, column_bytes, from_planes, mix, pack_sorted, planes, slices, unpack_sorted, words,
)

DEPTH = 2
SUPPORT = 2  # occurrences of a stored n-gram
DISCOUNT = 0.75
RANGE_BYTES = 1 << 24  # text bytes per hash range
FILE_BYTES = 1 << 23  # text bytes of the slices that one task holds
FLUSH = 3 << 17  # tokens of a slice, about
_TOKEN_BYTES = 6
_U = np.uint64
_LN10 = np.log(10.0)

_SLICE = "slice long, words binary, places binary, offsets binary, ids binary, flags binary"
_MESSAGE = "range int, slice long, kind int, keys binary, adds binary, ints binary, floats binary"
_REPLY = "slice long, range int, kind int, body binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _text_tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with the end tokens, n+1 offsets)."""
    hashes, ends = words(*column_bytes(part.column("text")))
    n = len(ends) - 1
    out = np.full(len(hashes) + n, END, _U)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(ends))] = hashes
    return out, ends + np.arange(n + 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the texts: sorted distinct words, and each token's place."""
    number = TaskContext.get().partitionId() << 32
    names = [f.split(" ")[0] for f in _SLICE.split(", ")]
    for batch in batches:
        for part in slices(batch, "text", _TOKEN_BYTES * FLUSH):
            tokens, offsets = _text_tokens(part)
            distinct, place = np.unique(tokens, return_inverse=True)
            ids, held = part.column("doc_id"), part.column("held_out")
            flags = 2 * np.asarray(ids.is_null()).astype(np.uint8) + np.asarray(held.fill_null(False)).astype(np.uint8)
            row = (
                number, pack_sorted(distinct), planes(place.astype(np.uint32)), offsets.astype("<i8").tobytes(),
                ids.fill_null(0).to_numpy().astype("<i8").tobytes(), flags.tobytes(),
            )
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([v], pa.binary()) for v in row[1:]]], names)
            number += 1


class _Keys:
    """The distinct keys of a slice that are looked up in the hash ranges."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.cuts = np.searchsorted(self.sorted, np.arange(1 << bits, dtype=_U) << _U(64 - bits)).tolist() + [len(hashes)]

    def parts(self) -> Iterator[tuple[int, np.ndarray, bytes]]:
        """(range, places of its keys, the keys packed)."""
        for r, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            if b > a:
                yield r, self.order[a:b], pack_sorted(self.sorted[a:b])

    def answered(self, bodies: dict[int, bytes], numbers: int) -> np.ndarray:
        """The ranges' answers, some numbers a key, in the order of the keys."""
        out = np.zeros((numbers, len(self.order)), np.int64)
        if len(self.order):
            out[:, self.order] = np.concatenate([from_planes(bodies[r], np.int64).reshape(numbers, -1) for r in sorted(bodies)], axis=1)
        return out


class _Slice:
    """A slice's n-grams of each order, as far as the replies reach.

    Of order k (list index k): ``keys`` (of the n-grams ``asked`` for, whose
    two shorter n-grams have ``SUPPORT``), ``count`` (0 below ``SUPPORT``; words:
    all), ``lead`` (this slice adds the term), ``context`` and ``below`` (places
    in order k-1 of all but the last and all but the first word), ``log_p`` (of
    the last word after the others), ``rest`` (lambda of the n-gram as a context,
    0 if it is not retained) and ``at`` (each token's n-gram that ends there, or -1)."""

    def __init__(self, row: pd.Series, bits: int, total: tuple[int, int], rounds: int):
        self.number, self.bits, self.total = int(row["slice"]), bits, total
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.flags, self.ids = np.frombuffer(row["flags"], np.uint8), np.frombuffer(row["ids"], "<i8")
        self.replies: dict[int, dict[int, bytes]] = {}
        for k in range(rounds):
            for r in () if row[f"got{k}"] is None else row[f"got{k}"]:
                self.replies.setdefault(int(r["kind"]), {})[int(r["range"])] = bytes(r["body"])
        self.hash = [np.zeros(0, _U), unpack_sorted(row["words"])]
        self.at = [np.zeros(0, np.int64), from_planes(row["places"], np.uint32).astype(np.int64)]
        self.train = np.repeat(self.flags & 1 == 0, np.diff(self.offsets))
        self.first = np.zeros(len(self.at[1]), bool)
        self.first[self.offsets[:-1]] = True
        none = np.zeros(0, np.int64)
        self.context, self.below, self.count, self.lead = [none, none], [none, none], [none], [none]
        self.rest, self.log_p, self.keys = [none], [none], [None, _Keys(self.hash[1], bits)]
        self.asked, self.states = [none, np.arange(len(self.hash[1]))], [none, none]
        self._counts(1)
        if self.count[1:]:
            n, v = total
            self.log_p.append(np.log(np.where(self.count[1] > 0, self.count[1], max(v, 1)) / (n + v)) if n + v else np.zeros(len(self.count[1])))

    def _counts(self, order: int) -> None:
        if order in self.replies or (self.replies and not len(self.asked[order])):
            value = np.zeros(len(self.hash[order]), np.int64)
            value[self.asked[order]] = self.keys[order].answered(self.replies.get(order, {}), 1)[0]
            self.count.append(value >> 1)
            self.lead.append((value & 1).astype(bool))

    def grams(self, order: int) -> None:
        """Adds the n-grams of the next order; contexts below ``SUPPORT``
        cannot be states and are left out once their counts are known."""
        before = np.full(len(self.first), -1, np.int64)
        before[1:] = np.where(self.first[1:], -1, self.at[order - 1][:-1])
        use = before >= 0
        if order > 2:
            use[use] = self.count[order - 1][before[use]] >= SUPPORT
        token = np.flatnonzero(use)
        key, place = np.unique((before[token] << 32) | self.at[1][token], return_inverse=True)
        some = np.zeros(len(key), np.int64)  # one token of each n-gram
        some[place] = token
        at = np.full(len(self.first), -1, np.int64)
        at[token] = place
        context = key >> 32
        self.at.append(at)
        self.context.append(context)
        self.below.append(self.at[order - 1][some])
        self.hash.append(mix(self.hash[order - 1][context] * _U(0x9E3779B97F4A7C15) + self.hash[1][key & 0xFFFFFFFF]))
        ask = self.count[order - 1][self.below[order]] >= SUPPORT if order > 2 else np.ones(len(key), bool)
        self.asked.append(np.flatnonzero(ask))
        self.keys.append(_Keys(self.hash[order][ask], self.bits))
        self.states.append(np.unique(context))  # of the shorter n-grams, those that are contexts here
        self._counts(order)

    def learn(self, order: int) -> None:
        """Retained contexts of ``order - 1`` words and P of the n-grams."""
        states = self.states[order]
        stored_, successors = _Keys(self.hash[order - 1][states], self.bits).answered(self.replies.get(1 - order, {}), 2)
        rest = np.clip(1 - (stored_ - DISCOUNT * successors) / np.maximum(self.count[order - 1][states], 1), 1e-12, 1)
        self.rest.append(np.zeros(len(self.hash[order - 1])))
        self.rest[-1][states] = np.where(successors > 0, rest, 0.0)
        context, c = self.context[order], self.count[order]
        lower, rest = self.log_p[order - 1][self.below[order]], self.rest[order - 1][context]
        state = rest > 0
        own = np.maximum(c - DISCOUNT, 0) / np.maximum(self.count[order - 1][context], 1) + np.where(state, rest, 1) * np.exp(lower)
        left = np.log(np.where(state, rest, 1)) + lower
        self.log_p.append(np.where(state & (c > 0), np.log(own), np.where(state, left, lower)))

    def ask_counts(self, order: int) -> list[tuple]:
        """The distinct n-grams and how often the training rows have them."""
        use = self.train & (self.at[order] >= 0)
        count = np.bincount(self.at[order][use], minlength=len(self.hash[order])).astype(np.uint32)[self.asked[order]]
        return [(r, self.number, order, packed, b"", planes(count[at]), b"") for r, at, packed in self.keys[order].parts()]

    def ask_states(self, order: int) -> list[tuple]:
        """The contexts of ``order - 1`` words, with the terms of the n-grams
        that this slice leads: successors, their count, N, divergence, mass of
        the successors after the suffix."""
        lead = self.lead[order] & (self.count[order] > 0)
        context, c = self.context[order][lead], self.count[order][lead]
        n, size = self.count[order - 1], len(self.hash[order - 1])
        q = np.exp(self.log_p[order - 1][self.below[order][lead]])
        p = c / n[context]
        add = lambda x: np.bincount(context, x, size)
        ints = np.stack((add(np.ones(len(c))), add(c), n)).astype(np.int64)
        floats = np.stack((add(p * np.log(p / q)), add(q)))
        out = []
        states = self.states[order]
        for r, at, packed in _Keys(self.hash[order - 1][states], self.bits).parts():
            at = states[at]
            has = ints[0][at] > 0
            some = at[has]
            out.append((r, self.number, 1 - order, packed, np.packbits(has).tobytes(), planes(ints[:, some].ravel()), floats[:, some].tobytes()))
        return out

    def scored(self) -> pd.DataFrame:
        (n, v), score = self.total, self.log_p[1][self.at[1]]
        for order in range(2, len(self.log_p)):  # a longer retained context overrides
            found = self.at[order] >= 0
            score[found] = self.log_p[order][self.at[order][found]]
        count = self.count[1][self.at[1]]
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        add = lambda x: np.bincount(doc, x, len(self.ids))
        return pd.DataFrame(
            {
                "doc_id": pd.Series(self.ids.astype(np.int64)).astype("Int64").mask(self.flags & 2 > 0),
                "held_out": (self.flags & 1).astype(bool), "n_tokens": np.diff(self.offsets), "n_known": add(count > 0).astype(np.int64),
                "train_tokens": n, "base_score": add(np.log10((count + 1.0) / (n + v + 1.0))), "score": add(score) / _LN10,
            }
        )


def _merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(message sizes, order by key, place of each entry's key, distinct keys)."""
    keys = [unpack_sorted(k) for k in group["keys"]]
    size, keys = np.array([len(k) for k in keys]), np.concatenate(keys)
    order = np.argsort(keys)
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return size, order, place, int(new.sum())


def _total_counts(kind: int, group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """(message sizes, 2 * count + does this slice lead, (keys, occurrences))."""
    size, order, place, n = _merged(group)
    count = np.concatenate([from_planes(c, np.uint32) for c in group["ints"]]).astype(np.int64)
    total = np.bincount(place, count, n).astype(np.int64)
    seen = order[count[order] > 0]
    lead = np.zeros(len(count), np.int64)
    lead[seen[np.concatenate(([True], np.diff(place[seen]) != 0))[: len(seen)]]] = 1
    kept = np.where(total >= SUPPORT, total, 0) if kind > 1 else total
    return size, 2 * kept[place] + lead, (int((total > 0).sum()), int(total.sum()))


def _states(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(message sizes, occurrences of the successors and their number: lambda
    follows from them; 0 of contexts that are not retained)."""
    size, _, place, k = _merged(group)
    has = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=s) for a, s in zip(group["adds"], size)]).astype(bool)
    at = place[has]
    ints = np.concatenate([from_planes(i, np.int64).reshape(3, -1) for i in group["ints"]], axis=1)
    floats = np.concatenate([np.frombuffer(f, float).reshape(2, -1) for f in group["floats"]], axis=1)
    add = lambda x: np.bincount(at, x, k)
    successors, stored_, divergence, q = add(ints[0]), add(ints[1]), add(floats[0]), add(floats[1])
    n = np.ones(k)
    n[at] = ints[2]
    p_rest, q_rest = np.maximum(1 - stored_ / n, 0), np.maximum(1 - q, 1e-12)
    divergence = divergence + np.where(p_rest > 0, p_rest * np.log(np.maximum(p_rest, 1e-300) / q_rest), 0)
    state = (successors > 0) & (2 * n * divergence > successors * np.log(np.maximum(n, 2)))
    return size, np.where(state, np.stack((stored_, successors)), 0).astype(np.int64)[:, place]


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Each slice's answers from one hash range; of the words also a row
    without slice with the numbers of distinct words and tokens (kind 0)."""
    out, r = [], int(group["range"].iloc[0])
    for kind, some in group.groupby("kind"):
        if kind > 0:
            size, value, total = _total_counts(int(kind), some)
            if kind == 1:
                out.append((None, r, 0, np.array(total, np.int64).tobytes()))
        else:
            size, value = _states(some)
        ends = np.cumsum(size)
        out += [(s, r, int(kind), planes(value[..., e - k : e].ravel())) for s, e, k in zip(some["slice"], ends, size)]
    frame = pd.DataFrame(out, columns=["slice", "range", "kind", "body"])
    return frame.astype({"slice": "Int64"})


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows for which ``held_out`` (over ``doc_id``) is false
    and scores all.  Returns doc_id, held_out, n_tokens (words and end), n_known,
    train_tokens, base_score (add-one unigram) and score, in log10."""
    total = text_bytes(docs, text_col)
    bits, files = buckets_for(total, RANGE_BYTES).bit_length() - 1, buckets_for(total, FILE_BYTES)
    rows = keyed(docs, id_col, text_col).withColumn("held_out", held_out).select("doc_id", "held_out", "text")

    def kept(df: DataFrame, tag: str) -> DataFrame:
        out = stored_by(df, tag, "slice", files)
        docs.sparkSession._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of the rounds that are done
        return out

    cut = kept(rows.mapInArrow(_cut, _SLICE), "lm-slices")
    names = [f.split(" ")[0] for f in _MESSAGE.split(", ")]
    replies: list[DataFrame] = []

    def each_slice(work, schema: str) -> DataFrame:
        """What ``work`` makes of each slice and the replies to it so far."""
        met = cut
        for k, some in enumerate(replies):
            got = some.where("slice is not null").groupBy("slice").agg(F.collect_list(F.struct("range", "kind", "body")).alias(f"got{k}"))
            met = met.join(got, "slice", "left")
        rounds = len(replies)
        return met.groupBy("slice").applyInPandas(lambda own: work(own.iloc[0], rounds), schema)

    def replies_to(messages: DataFrame) -> DataFrame:
        return kept(messages.groupBy("range").applyInPandas(_answer, _REPLY), "lm-replies")

    def begin(row: pd.Series, rounds: int) -> pd.DataFrame:
        part = _Slice(row, bits, (0, 0), rounds)
        part.grams(2)
        return pd.DataFrame(part.ask_counts(1) + part.ask_counts(2), columns=names)

    replies.append(replies_to(each_slice(begin, _MESSAGE)))
    sizes = [np.frombuffer(r["body"], np.int64) for r in replies[0].where("slice is null").select("body").collect()]  # one per range
    v, n = (int(x) for x in np.sum(sizes, axis=0)) if sizes else (0, 0)

    def go_on(step: int):
        """States of contexts of ``step`` words, counts of the next n-grams."""

        def ask(row: pd.Series, rounds: int) -> pd.DataFrame:
            part = _Slice(row, bits, (n, v), rounds)
            part.grams(2)
            for order in range(2, step + 1):
                part.learn(order)
                part.grams(order + 1)
            out = part.ask_states(step + 1)
            if step < DEPTH:
                part.grams(step + 2)
                out += part.ask_counts(step + 2)
            return pd.DataFrame(out, columns=names)

        return ask

    def finish(row: pd.Series, rounds: int) -> pd.DataFrame:
        part = _Slice(row, bits, (n, v), rounds)
        for order in range(2, DEPTH + 2):
            part.grams(order)
            part.learn(order)
        return part.scored()

    for step in range(1, DEPTH + 1):
        replies.append(replies_to(each_slice(go_on(step), _MESSAGE)))
    return each_slice(finish, _RESULT)
