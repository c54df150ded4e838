from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from churnscope.llm import queries, suffix_dedup
from churnscope.llm.storage import keyed
from churnscope.llm.suffix_dedup import multikey_sort, remove_repeats, segments


def brute(raws, length):
    """Removed runs of each text."""
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
    return out


def test_multikey_sort_finds_equal_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    for length in (3, 8, 11, 24):
        starts = np.arange(len(data) - length)
        classes, common = multikey_sort(data, starts, np.zeros(len(starts), np.int64), length)
        texts = [data[s : s + length].tobytes() for s in starts]
        seen = Counter(texts)
        assert [c >= 0 for c in classes] == [seen[t] > 1 for t in texts]
        by = {}
        for t, c in zip(texts, classes.tolist()):
            if c >= 0:
                assert by.setdefault(c, t) == t
        assert len(by) == sum(v > 1 for v in seen.values())
    for s in range(0, 2900, 97):  # never below the longest common prefix
        one = data[s : s + 24].tobytes()
        longest = max(next((k for k in range(24) if data[t + k] != one[k]), 24) for t in starts if t != s)
        assert longest <= common[s] <= longest + 7


@pytest.mark.parametrize("length", [5, 40])
def test_segments_hold_every_window_once(length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 9)
    rng = np.random.default_rng(1)
    sizes = [0, 3, 700, length, length - 1, 250]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    offsets = np.cumsum([0, *sizes])
    doc, first, width, lead, _, _ = segments(data, offsets, length)
    windows = [w for f, n in zip(first, width) for w in range(f, f + n + 1)]
    assert sorted(windows) == [w for d in range(6) for w in range(offsets[d], offsets[d + 1] - length + 1)]
    assert ((0 <= lead) & (lead <= length)).all()


@pytest.mark.parametrize("length,hot", [(20, 4000), (20, 1), (37, 2)])
def test_equals_brute_force(spark, docs_frame, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 25))) for _ in range(5)]
    texts = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages)[rng.randint(0, 6) :])
        texts.append(" ".join(parts))
    texts += ["a" * 300, "xyz" * 50, "", None, texts[3], texts[3], "end " * 2000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, texts[7]), (7, texts[7])]
    frame = docs_frame(rows).selectExpr("*", "1 as row_key", "2 as gram", "3 as starts", "4 as rest")
    got = remove_repeats(frame, length).collect()
    want = brute([(t or "").encode() for _, t in rows], length)
    expected = sorted((str(i), hashlib.md5((t or "").encode()).hexdigest(), w) for (i, t), w in zip(rows, want))
    found = sorted((str(r.row.doc_id), hashlib.md5((r.row.text or "").encode()).hexdigest(), list(zip(r.starts, r.ends))) for r in got)
    assert found == expected
    assert set(got[0].row.asDict()) == set(frame.columns)
    assert all(r.kept.encode() in (r.row.text or "").encode() for r in got if len(r.starts) == 0)


def test_empty_table(docs_frame):
    assert remove_repeats(docs_frame([])).collect() == []


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows], 400)))
    got = queries.op8_suffix_dedup(spark, d).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    texts = {r.doc_id: r.text.encode() for r in rows}
    for r in got:
        runs, raw = want[r.doc_id], texts[r.doc_id]
        kept = suffix_dedup.kept_text(raw, runs)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(b - a for a, b in runs), len(runs))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_slices_without_repeats_keep_the_schema(spark, docs_frame):
    """Several slices in one batch, the first of them free of repeats."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = text(500)
    rows = [(i, text(40_000)) for i in range(60)] + [(i, text(30_000) + shared + text(5_000)) for i in range(60, 70)]
    found = remove_repeats(docs_frame(rows).coalesce(1)).collect()
    cut = {r.row.doc_id: r.ends[0] - r.starts[0] for r in found if r.starts}
    assert len(found) == 70 and set(cut) == set(range(60, 70)) and all(500 <= n <= 504 for n in cut.values())


def test_long_texts_are_worked_in_pieces(monkeypatch):
    """A long text is hashed piece by piece, with every window in one segment."""
    seen, work = [], suffix_dedup._slice_segments
    monkeypatch.setattr(suffix_dedup, "_slice_segments", lambda data, *rest: seen.append(len(data)) or work(data, *rest))
    data = np.random.default_rng(2).integers(0, 256, 1_000_000).astype(np.uint8)
    _, first, width, *_ = suffix_dedup.segments(data, np.array([0, len(data)]), 400)
    assert max(seen) <= 1 << 19
    covered = np.concatenate([np.arange(a, a + w + 1) for a, w in zip(first, width)])
    assert (np.sort(covered) == np.arange(len(data) - 399)).all()


def test_equal_segments_of_a_slice_travel_together():
    """One row for up to PACK places of a segment, and no place is lost."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = text(2000)
    texts = [text(rng.randint(0, 30)) + shared for _ in range(100)] + [shared + text(900), "", text(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["row_key", "text"])
    rows = [r for out in suffix_dedup._find_segments(400)(iter([batch])) for r in out.to_pylist()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    doc, first, width, lead, gram, content = segments(data, offsets, 400)
    want = Counter(zip(doc, first - offsets[doc], width, lead, gram.view(np.int64), content.view(np.int64)))
    got = Counter()
    for r in rows:
        places = [(r["row_key"], r["first"]), *[(o["row_key"], o["first"]) for o in r["others"] or ()]]
        assert len(places) <= suffix_dedup.PACK
        got.update((k, f, r["width"], r["lead"], r["gram"], r["content"]) for k, f in places)
    assert got == want
    kinds = Counter((r["gram"], r["content"]) for r in rows)
    assert max(kinds.values()) == -(-101 // suffix_dedup.PACK) and len(rows) < len(first) / 2


def test_copies_of_a_row_get_their_marks_once(spark, docs_frame):
    """Rows that repeat id and text share a key: each mark is kept once, not
    once a copy, as every copy receives all of them."""
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghij ", k=3000))
    frame = docs_frame([(None, text)] * 50 + [(1, "x" + text)])
    own = keyed(frame.repartition(4), "doc_id", "text").select("row_key", "text")
    marks = suffix_dedup.repeat_marks(own, 400).collect()
    windows = [sum(b - a for m in r.marks for a, b in zip(m["starts"], m["ends"])) for r in marks]
    assert sorted(windows) == [2601, 2601]
    got = remove_repeats(frame).collect()
    assert Counter((r.row.doc_id, r.kept) for r in got) == {(None, ""): 50, (1, "x"): 1}


def test_places_of_a_document_come_back_as_one_row(spark, docs_frame):
    """A passage of several segments in n texts: one row a text with the ranges
    of its repeated windows, not one row per segment and text."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    one, two = text(3000), text(2500)
    texts = [text(600) + one + text(600) + (two if i % 2 else "") + text(50) for i in range(80)]
    frame = docs_frame(list(enumerate(texts))).repartition(3)
    own = keyed(frame, "doc_id", "text").select("row_key", "text")
    found = suffix_dedup.repeated_windows(own, 400).collect()
    whole = [r for r in found if r.ends[-1] - r.starts[0] > 1500]  # the others: windows at the passages' edges
    assert Counter(r.row_key for r in whole) == {r.row_key: 1 for r in own.collect()}
    assert Counter(len(r.starts) for r in whole) == {1: 40, 2: 40}
    assert len(found) <= 80 * 5
    want = dict(enumerate(brute([t.encode() for t in texts], 400)))
    assert {r.row.doc_id: list(zip(r.starts, r.ends)) for r in remove_repeats(frame).collect()} == want


@pytest.mark.parametrize("rows", [1, 2, 7, 1000])
def test_slices_span_batches(rows):
    """Packs of slices that go on in the next batch, in batches of any size."""
    rng = random.Random(9)
    data, want = [], {}
    for number in range(12):
        for key in rng.sample(range(100), 4):
            edges = sorted(rng.sample(range(60), 8))
            for a, b in zip(edges, edges[1:]):
                data.append({"slice": number, "row_key": key, "first": a, "width": b - a - 1, "others": rng.choice([None, [{"row_key": key + 1000, "first": a}]])})
                want.setdefault(key, set()).update(range(a, b))
                if data[-1]["others"]:
                    want.setdefault(key + 1000, set()).update(range(a, b))
    places = pa.list_(pa.struct([("row_key", pa.int64()), ("first", pa.int64())]))
    schema = pa.schema([("slice", pa.int64()), ("row_key", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("others", places)])
    batches = pa.Table.from_pylist(data, schema).to_batches(max_chunksize=rows)
    out = [r for b in suffix_dedup._ranges_by_document(iter(batches)) for r in b.to_pylist()]
    got = {}
    for r in out:
        for a, b in zip(r["starts"], r["ends"]):
            got.setdefault(r["row_key"], set()).update(range(r["first"] + a, r["first"] + b))
    assert got == want
    slices_of = Counter(k for n in range(12) for k in {x["row_key"] for x in data if x["slice"] == n})
    assert all(n <= slices_of[k] for k, n in Counter(r["row_key"] for r in out).items() if k < 1000)
