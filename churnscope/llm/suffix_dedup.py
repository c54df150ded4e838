"""Removal of repeated byte strings by sorted suffixes.

Every string of ``length`` bytes that starts at two or more places (in two
documents or twice in one, overlaps included) is removed wherever it occurs.
Strings never cross documents and are judged on the input.

Which suffixes can matter.  Each window of ``length`` bytes names an anchor:
the place of its smallest ``gram``-byte hash (the first such place on ties),
which depends on the window's bytes alone.  Equal windows have equal anchors
at equal places, so only windows whose anchor gram occurs again can repeat.
The windows of one anchor start at consecutive places; together they are a
*segment* of at most ``2 * length`` bytes, and there is about one segment per
``length / 2`` bytes.  Segments, not bytes, are shuffled.

1. Segments are counted by (anchor gram, content hash).  A segment found twice
   repeats whole, however hot it is.  Equal segments of one slice of text
   travel together, up to ``PACK`` places to a row.
2. An anchor gram with several different segments needs their suffixes
   compared.  One representative per segment is cut out of its text; Spark
   samples splitters of the leading bytes (the gram) and range-partitions the
   segments by them.  Within a bucket, the suffixes that start at the windows
   are sorted by multikey quicksort, eight bytes to a key, all groups of a
   round at once; suffixes that stay together for ``length`` bytes repeat.
   Equal leading bytes never straddle a range boundary.  A gram with more than
   ``HOT`` segments is not put into one bucket: its windows are dealt by a
   128-bit hash of their content, which brings equal windows of all buckets
   together.
3. The repeated windows go back to the documents: those of a segment found once
   to its only place; the packs of the others meet by slice of text, where all
   places of a document become one row of window ranges.

Defined cases: NULL text is empty; texts shorter than ``length`` lose nothing;
repeated rows are copies and lose every window; an empty table gives no rows;
very long texts are worked in overlapping slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import arrow_columns, arrow_fields, keyed, stored
from churnscope.llm.text_arrays import BYTE_VALUE, column_bytes, mix, prefix_hash, slices, span_hash

LENGTH = 400
SLICE_BYTES = 1 << 18  # of text worked at once: some ten 8-byte numbers a byte are held
SORT_BYTES = 1 << 20  # of segments sorted at once
HOT = 4000
PACK = 32  # places of a segment in one row
_PLACE_BITS = 24
_U = np.uint64


def gram_bytes(length: int) -> int:
    return max(1, min(32, length // 4))


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window - first, anchor - first, gram hash,
    content hash) of each segment; windows are places in ``data``."""
    out: list[tuple[np.ndarray, ...]] = []
    step = min(max(SLICE_BYTES, 2 * length), (1 << _PLACE_BITS) - 2 * length)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    for low in range(0, max(0, len(data) - length + 1), step):
        out.append(_slice_segments(data[low : low + step + length - 1], doc_end[low : low + step + length - 1] - low, length, low, offsets))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(c) for c in zip(*out))


def _slice_segments(data, doc_end, length, low, offsets) -> tuple[np.ndarray, ...]:
    gram = gram_bytes(length)
    wide = length - gram + 1  # grams of a window
    prefix = prefix_hash(BYTE_VALUE[data])
    at = np.arange(len(data) - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram))
    least = (grams & ~_U((1 << _PLACE_BITS) - 1)) | at.astype(_U)
    size = 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    anchor = (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    place = np.arange(len(anchor))
    real = place + length <= doc_end[: len(anchor)]
    fresh = real.copy()
    fresh[1:] &= ~real[:-1] | (anchor[1:] != anchor[:-1])
    final = real.copy()
    final[:-1] &= ~real[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(fresh), np.flatnonzero(final)
    lead = anchor[first] - first
    shape = mix((lead.astype(_U) << _U(32)) | (last - first).astype(_U))
    content = mix(span_hash(prefix, first, last + length) ^ shape)
    doc = np.searchsorted(offsets, first + low, side="right") - 1
    return doc, first + low, last - first, lead, grams[anchor[first]], content


def packs(gram: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (gram, content) side by side, and where in it
    each run of at most ``PACK`` of them begins; runs are ordered by their
    first members."""
    n = len(gram)
    order = np.lexsort((content, gram))
    fresh = np.ones(n, bool)
    fresh[1:] = (np.diff(gram[order]) != 0) | (np.diff(content[order]) != 0)
    begin = np.flatnonzero(fresh)
    rank = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
    head = rank % PACK == 0
    first, run = order[head], np.cumsum(head) - 1
    size = np.bincount(run)[np.argsort(first)]
    return order[np.argsort(first[run], kind="stable")], np.cumsum(size) - size


def multikey_sort(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes ``starts`` of ``data`` to a depth of ``length`` bytes
    within each group.  Returns the classes of suffixes equal to that depth
    (numbers; -1 for a suffix equal to no other), and for each suffix a bound
    on its longest common prefix with another one of its group (at most seven
    bytes too long).

    Multikey quicksort, all groups of a depth in one pass: the suffixes still
    tied are ordered by their next eight bytes, which splits each group, and
    groups of one are done."""
    found, common = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int64)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    order = np.argsort(groups, kind="stable")
    active, group = order, np.cumsum(np.diff(groups[order], prepend=groups[order][:1]) != 0)
    depths = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 and length > 8 else [0] if length < 8 else [])
    width = min(8, length)
    for depth in depths:
        size = np.bincount(group)
        tied = size[group] > 1
        active, group = active[tied], group[tied]
        if not len(active):
            return found, common
        common[active] = depth + 7
        at = starts[active] + depth
        word = np.zeros(len(at), _U)
        for b in range(width):  # big-endian words order as bytes do
            word = (word << _U(8)) | padded[at + b].astype(_U)
        order = np.lexsort((word, group))
        active, group, word = active[order], group[order], word[order]
        group = np.cumsum(np.concatenate(([0], (np.diff(group) != 0) | (word[1:] != word[:-1]))))
    tied = np.bincount(group)[group] > 1
    found[active[tied]] = group[tied]
    common[active[tied]] = length
    return found, common


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _repeated_windows(grams, leads, widths, raws, length) -> list[np.ndarray]:
    """For each segment, a flag per window: does another segment of its gram
    hold it?  ``grams`` numbers the anchor grams of the segments."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    lead, count, gram = np.asarray(leads), np.asarray(widths) + 1, np.asarray(grams)
    base = np.cumsum([0, *[len(r) for r in raws[:-1]]])
    # The suffixes at the anchors, read forwards and backwards: how far does
    # any other segment agree?  A window fits only if both sides reach it.
    right = np.minimum(multikey_sort(data, base + lead, gram, length)[1], length)
    left = np.minimum(multikey_sort(data[::-1], len(data) - (base + lead), gram, length)[1], lead)
    low = np.maximum(lead - left, 0)
    high = np.minimum(lead - (length - right), count - 1)
    fits = np.maximum(high - low + 1, 0)
    owner = np.repeat(np.arange(len(raws)), fits)
    window = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits)
    # equal windows have the anchor at the same distance
    same = multikey_sort(data, base[owner] + window, gram[owner] * (length + 1) + lead[owner] - window, length)[0] >= 0
    out = np.zeros(int(count.sum()), bool)
    first = np.cumsum(count) - count
    out[first[owner[same]] + window[same]] = True
    return np.split(out, first[1:])


_PLACES = "array<struct<row_key:bigint,first:bigint>>"
_SEGMENT = f"slice long, row_key long, first long, width int, lead int, gram long, content long, others {_PLACES}"
_WINDOWS = "row_key long, first long, starts array<int>, ends array<int>"
_CUT = "gram long, content long, lead int, width int, leading binary, raw binary"


def _find_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = column_bytes(part.column("text"))
                doc, first, width, lead, gram, content = segments(data, offsets, length)
                order, at = packs(gram, content)
                key, place = part.column("row_key").to_numpy()[doc][order], (first - offsets[doc])[order]
                rest, more = np.delete(np.arange(len(order)), at), np.diff(at, append=len(order)) - 1
                others = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *more]), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(key[rest]), pa.array(place[rest])], ["row_key", "first"]),
                    mask=pa.array(more == 0),
                )
                one = order[at]
                number = uuid.uuid4().int >> 65  # not of the rows, which may repeat
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), number)), pa.array(key[at]), pa.array(place[at]), pa.array(width[one].astype(np.int32)),
                        pa.array(lead[one].astype(np.int32)), pa.array(gram[one].view(np.int64)), pa.array(content[one].view(np.int64)), others,
                    ],
                    ["slice", "row_key", "first", "width", "lead", "gram", "content", "others"],
                )

    return run


def _ranges_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs in the order of their slices, all windows of which repeat, as one
    row a slice and row key: the ranges that the windows of all places fill."""

    def merged(packs: pa.Table) -> pa.RecordBatch:
        others = packs.column("others").combine_chunks()
        more = others.flatten()
        key = np.concatenate((packs.column("row_key").to_numpy(), more.field("row_key").to_numpy()))
        first = np.concatenate((packs.column("first").to_numpy(), more.field("first").to_numpy()))
        count = pc.fill_null(pc.list_value_length(others), 0).to_numpy()
        width = packs.column("width").to_numpy()
        end = first + np.concatenate((width, np.repeat(width, count))) + 1
        order = np.lexsort((first, key))
        key, first, end = key[order], first[order], end[order]
        document = np.cumsum(np.diff(key, prepend=key[:1]) != 0) << 40  # further than any place
        reach = np.maximum.accumulate(document + end)
        begin = np.flatnonzero(np.concatenate(([True], document[1:] + first[1:] > reach[:-1])))
        final = np.append(begin[1:], len(key)) - 1
        at = np.flatnonzero(np.diff(document[begin], prepend=-1))
        bounds = pa.array(np.append(at, len(begin)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (first[begin], (reach - document)[final])]
        return pa.RecordBatch.from_arrays([pa.array(key[begin[at]]), pa.array(np.zeros(len(at), np.int64)), *lists], ["row_key", "first", "starts", "ends"])

    held: list[pa.RecordBatch] = []  # of the slice that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("slice").to_numpy()
        cut = int(np.searchsorted(number, number[-1]))
        if cut or (held and held[-1].column("slice")[-1].as_py() != number[0]):
            yield merged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield merged(pa.Table.from_batches(held))


def _cut_out(length: int):
    gram_size = gram_bytes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out: list[tuple] = []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    raw = text.encode()
                    for w in wanted:
                        piece = raw[w["first"] : w["first"] + w["width"] + length]
                        out.append((w["gram"], w["content"], w["lead"], w["width"], piece[w["lead"] : w["lead"] + gram_size], piece))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                names = [f.split(" ")[0] for f in _CUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)

    return run


def _sort_bucket(length: int):
    """Reads a bucket in the order of the leading bytes, some grams at a time."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def compare(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """``rows`` hold whole grams."""
        distinct = {(r["leading"], r["gram"], r["content"]): r for r in rows}  # a repeated row's copies came twice
        number: dict[tuple, int] = {}
        rows = list(distinct.values())
        grams = [number.setdefault(k[:2], len(number)) for k in distinct]
        out = []
        for r, flag in zip(rows, _repeated_windows(grams, *[[r[c] for r in rows] for c in ("lead", "width", "raw")], length)):
            if flag.any():
                a, b = _ranges(flag)
                out.append((r["gram"], r["content"], a.tolist(), b.tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["gram", "content", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size > SORT_BYTES and (r["leading"], r["gram"]) != (held[-1]["leading"], held[-1]["gram"]):
                    yield from compare(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["raw"])
        if held:
            yield from compare(held)

    return run


def _deal_windows(length: int):
    """(gram, content, window, hash of distance to the anchor and bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, n = np.frombuffer(r["raw"], np.uint8), r["width"] + 1
                at = np.arange(n)
                one = span_hash(prefix_hash(BYTE_VALUE[data]), at, at + length)
                two = span_hash(prefix_hash(mix(BYTE_VALUE[data])), at, at + length)
                distance = mix((r["lead"] - at).astype(np.int64).view(_U))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["gram"])), pa.array(np.full(n, r["content"])), pa.array(at.astype(np.int32)), pa.array((one ^ distance).view(np.int64)), pa.array((two + distance).view(np.int64))],
                    ["gram", "content", "window", "one", "two"],
                )

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(row_key, first, starts, ends) for ``docs`` (row_key, text): places of the
    text at which windows start that occur again, as ranges of window starts
    relative to ``first``."""
    found = stored(docs.mapInArrow(_find_segments(length), _SEGMENT), "segments")
    kinds = stored(
        found.groupBy("gram", "content").agg(
            F.sum(1 + F.coalesce(F.array_size("others"), F.lit(0))).alias("n"), F.first("row_key").alias("row_key"), F.first("first").alias("first"),
            F.first("width").alias("width"), F.first("lead").alias("lead"),
        ),
        "segment-kinds",
    )
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    compared = kinds.join(several, "gram")
    wanted = compared.groupBy("row_key").agg(
        F.collect_list(F.struct("gram", "content", "first", "width", "lead")).alias("wanted")
    )
    cut = docs.join(wanted, "row_key").select("text", "wanted").mapInArrow(_cut_out(length), _CUT)
    hot = several.where(F.col("kinds") > HOT).select("gram")
    cold = cut
    spread = None
    if hot.limit(1).count():
        cut = stored(cut, "segment-bytes")
        cold = cut.join(hot, "gram", "left_anti")
        dealt = stored(
            cut.join(hot, "gram").mapInArrow(_deal_windows(length), "gram long, content long, window int, one long, two long").distinct(),
            "hot-windows",
        )
        again = dealt.groupBy("gram", "one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "one", "two")
        spread = dealt.join(again, ["gram", "one", "two"]).groupBy("gram", "content").agg(
            F.sort_array(F.collect_list("window")).alias("starts")
        ).withColumn("ends", F.transform("starts", lambda w: w + 1))
    sorted_ = cold.repartitionByRange("leading").sortWithinPartitions("leading", "gram")
    parts = sorted_.mapInArrow(_sort_bucket(length), "gram long, content long, starts array<int>, ends array<int>")
    if spread is not None:
        parts = parts.unionByName(spread.select("gram", "content", "starts", "ends"))
    # a segment found twice repeats whole; only the others take the sorted result
    once = stored(
        parts.join(kinds.where("n = 1").select("gram", "content", "row_key", "first"), ["gram", "content"]).select("row_key", "first", "starts", "ends"),
        "repeated-segments",
    )
    whole = found.join(kinds.where("n > 1").select("gram", "content"), ["gram", "content"], "left_semi")
    # the places of a document, which the join has scattered, meet again by slice
    packs = whole.select("slice", "row_key", "first", "width", "others").repartition("slice").sortWithinPartitions("slice")
    whole = packs.mapInArrow(_ranges_by_document, _WINDOWS)
    return whole.unionByName(once)


def repeat_marks(docs: DataFrame, length: int) -> DataFrame:
    """(row_key, marks): the ranges of ``repeated_windows`` by document, once
    for all copies of a repeated row."""
    found = repeated_windows(docs, length)
    return found.groupBy("row_key").agg(F.collect_set(F.struct("first", "starts", "ends")).alias("marks"))


def map_kept(
    docs: DataFrame, finish: Callable[[bytes, list[tuple[int, int]]], tuple], fields: str, length: int = LENGTH,
    carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``row`` (the columns ``carry``) and ``fields``, which ``finish`` makes of
    each document's UTF-8 bytes and its maximal removed [start, end) runs."""
    carry = docs.columns if carry is None else carry
    own = keyed(docs, id_col, text_col).select("row_key", "text")
    marks = repeat_marks(own, length)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = [c for c in carry if c != text_col]
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(marks, "row_key", "left").select("rest", "text", "marks")
    made = arrow_fields(fields)
    names = made.names
    keep_text = text_col in carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                out = []
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                    raw = (text or "").encode()
                    change = np.zeros(len(raw) + 1, np.int64)
                    for m in marks or ():
                        first = m["first"]
                        for a, b in zip(m["starts"], m["ends"]):
                            change[first + a] += 1
                            change[first + b - 1 + length] -= 1
                    starts, ends = _ranges(np.cumsum(change[:-1]) > 0)
                    out.append(finish(raw, list(zip(starts.tolist(), ends.tolist()))))
                columns = [part.column("rest"), *([part.column("text")] if keep_text else []), *arrow_columns(out, made)]
                yield pa.RecordBatch.from_arrays(columns, ["rest", *(["text"] if keep_text else []), *names])

    schema = joined.select("rest", *(["text"] if keep_text else [])).schema
    done = joined.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, {fields}")
    parts = {c: F.col("text") if c == text_col else F.col("rest").getField(c) for c in carry}
    return done.select(F.struct(*[v.alias(c) for c, v in parts.items()]).alias("row"), *names)


def kept_text(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes."""
    at, out = 0, []
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``kept`` (the text without repeated strings; a character cut in
    two is dropped), ``starts`` and ``ends`` (bytes) of the removed runs."""

    def finish(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
        return kept_text(raw, runs).decode("utf-8", "ignore"), [a for a, _ in runs], [b for _, b in runs]

    return map_kept(docs, finish, "kept string, starts array<long>, ends array<long>", length, carry, id_col, text_col)
