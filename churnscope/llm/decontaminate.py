"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised bytes may occur in a document with up to
``m // PIECE - 1`` edits.  Cut into ``budget + 1`` pieces, at least one piece
of any such occurrence is untouched, so exact piece hits find every candidate
place; each is verified with Myers' bit-parallel edit distance (the item
against any stretch of the window around the hit), which also gives the place.
Items under ``2 * PIECE`` bytes have no budget and must occur exactly.

Both sides are normalised alike: ASCII and Latin-1 capitals to small letters,
runs of ASCII characters other than letters and digits to one blank.

Scale: items are handled in blocks of a fixed size (so a large benchmark means
more passes, not more memory); a block travels as a broadcast, and documents
are searched where they are read, without a shuffle.  All piece positions are
found by rolling hashes over flat arrays; only hits are touched one by one.

Defined cases: NULL texts are empty and match nothing, nor does an item
without a letter or digit; NULL item ids are reported as NULL; repeated items
are reported each; an empty benchmark or document table gives clean documents
or no rows; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.text_arrays import BYTE_VALUE, column_bytes, mix, prefix_hash, slices, span_hash

PIECE = 16
BLOCK_ITEMS = 4096
SLICE_BYTES = 1 << 20
_FILTER_BITS = 22
_U = np.uint64

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, n+1 offsets, original place of each byte)."""
    out = _FOLD[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    blank = out == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    keep[starts] = ~blank[starts]  # no blank in front
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, offsets), place


def edit_search(pattern_masks: dict[int, int], m: int, text: bytes) -> tuple[int, int]:
    """Myers' algorithm: (smallest edit distance of the pattern to a stretch of
    ``text``, end of the first such stretch)."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = pattern_masks.get(c, 0)
        down = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        plus_h = minus | (ones & ~(diagonal | plus))
        minus_h = plus & diagonal
        if plus_h & top:
            score += 1
        elif minus_h & top:
            score -= 1
        plus_h = plus_h << 1 & ones  # a stretch may start anywhere: no 1 enters
        minus_h = minus_h << 1 & ones
        plus = minus_h | (ones & ~(down | plus_h))
        minus = plus_h & down
        if score < best:
            best, end = score, at
    return best, end


def masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class ItemBlock:
    """The pieces of a block of items, by length class of their hash."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.budget = [max(0, len(t) // PIECE - 1) for t in texts]
        self.masks = [masks(t) for t in texts]
        self.reversed = [masks(t[::-1]) for t in texts]
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # hashed bytes -> item, start, end
        for i, t in enumerate(texts):
            n = self.budget[i] + 1
            cuts = [len(t) * k // n for k in range(n + 1)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    pieces.setdefault(min(b - a, PIECE), []).append((i, a, b))
        self.classes = []
        for q, found in pieces.items():
            joined = np.frombuffer(b"".join(texts[i][a : a + q] for i, a, _ in found), np.uint8)
            prefix = prefix_hash(BYTE_VALUE[joined])
            start = np.arange(len(found)) * q
            key = span_hash(prefix, start, start + q)
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(mix(key) >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.classes.append((q, key[order], bits, [found[k] for k in order]))

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place of an untouched piece in ``data``, place where its item would
        then start, item)."""
        raw, prefix = data.tobytes(), prefix_hash(BYTE_VALUE[data])
        for q, keys, bits, pieces in self.classes:
            if len(data) < q:
                continue
            at = np.arange(len(data) - q + 1)
            h = span_hash(prefix, at, at + q)
            maybe = np.flatnonzero(bits[(mix(h) >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            for p, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for k in range(a, b):
                    item, start, end = pieces[k]
                    if raw.startswith(self.texts[item][start:end], p):
                        yield p, p - start, item

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, distance, start, end) of the best occurrence of each
        item within its budget in each document."""
        windows: dict[tuple[int, int], list[int]] = {}
        if not len(data):
            return []
        for p, at, item in self.hits(data):
            doc = int(np.searchsorted(offsets, p, side="right")) - 1
            windows.setdefault((doc, item), []).append(at)
        out = []
        for (doc, item), places in windows.items():
            text, k = self.texts[item], self.budget[item]
            low, high = int(offsets[doc]), int(offsets[doc + 1])
            spans: list[list[int]] = []
            for at in sorted(set(places)):
                a, b = max(low, at - k), min(high, at + len(text) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            best = None
            for a, b in spans:
                piece = data[a:b].tobytes()
                exact = piece.find(text)
                if exact >= 0:
                    best = (0, a + exact, a + exact + len(text))
                    break
                distance, end = edit_search(self.masks[item], len(text), piece)
                if distance <= k and (best is None or distance < best[0]):
                    _, back = edit_search(self.reversed[item], len(text), piece[:end][::-1])
                    best = (distance, a + end - back, a + end)
            if best:
                out.append((doc, item, *best))
        return sorted(out)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[ItemBlock]:
    items = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = -(-items.count() // BLOCK_ITEMS)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).collect() if n > 1 else items.collect()
        rows.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
        data, offsets, _ = normalise(*column_bytes(pa.array([r["text"] for r in rows], pa.string())))
        texts = [data[a:b].tobytes().strip() for a, b in zip(offsets[:-1], offsets[1:])]
        use = [i for i, t in enumerate(texts) if t]
        yield ItemBlock([rows[i]["id"] for i in use], [texts[i] for i in use])


FIELDS = "item_ids array<long>, distances array<int>, starts array<long>, ends array<long>"


def find_items(
    docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) as the struct ``row``
    and, of every item found in the document, its id, edit distance and byte
    span in the original text (arrays ``item_ids``, ``distances``, ``starts``,
    ``ends``)."""
    carry = docs.columns if carry is None else carry
    wanted = list(dict.fromkeys([*carry, text_col]))
    place = {c: f"c{i}" for i, c in enumerate(wanted)}
    out = docs.select(*[F.col(f"`{c}`").alias(place[c]) for c in wanted])
    out = out.select("*", *[F.array().cast(t.split(" ")[1]).alias(t.split(" ")[0]) for t in FIELDS.split(", ")])
    text, names = place[text_col], ["item_ids", "distances", "starts", "ends"]
    for block in _blocks(benchmark, item_col, item_text_col):
        out = _search(out, block, text, names)
    return out.select(F.struct(*[F.col(place[c]).alias(c) for c in carry]).alias("row"), *names)


def _search(docs: DataFrame, block: ItemBlock, text: str, names: list[str]) -> DataFrame:
    """Adds one block's finds to the arrays."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    plain = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                data, offsets, origin = normalise(*(raw := column_bytes(part.column(text))))
                found = [[list(v or []) for v in part.column(n).to_pylist()] for n in names]
                for doc, item, distance, start, end in block.matches(data, offsets):
                    base = int(raw[1][doc])
                    row = (block.ids[item], distance, int(origin[start]) - base, int(origin[end - 1]) + 1 - base)
                    for column, value in zip(found, row):
                        column[doc].append(value)
                types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in plain], *[pa.array(c, t) for c, t in zip(found, types)]], [*plain, *names]
                )

    return docs.select(*plain, *names).mapInArrow(run, docs.select(*plain, *names).schema)
