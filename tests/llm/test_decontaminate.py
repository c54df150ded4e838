from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from churnscope.llm import decontaminate, queries
from churnscope.llm.decontaminate import edit_search, find_items, masks, normalise
from churnscope.llm.text_arrays import column_bytes


def brute_search(pattern, text):
    """(smallest distance of the pattern to a stretch of the text, its end)."""
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i - 1] + (p != c), column[i] + 1, new[-1] + 1))
        column = new
        best = min(best, (column[-1], j), key=lambda b: b[0])
    return best


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(400):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
        assert edit_search(masks(p), len(p), t) == brute_search(p, t)


def plain(text):
    data, _, _ = normalise(*column_bytes(pa.array([text])))
    return data.tobytes().strip()


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_brute_force_on_edited_items(spark, docs_frame, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30))).capitalize() + ".") for i in range(12)] + [(50, "Short"), (51, None), (52, "!!")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            text = items[rng.randrange(12)][1]
            body.insert(rng.randint(0, len(body)), edited(rng, text, rng.randint(0, len(text) // 12)))
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "a short one"), (103, "x " * 20_000 + items[3][1].upper()), (None, items[0][1]), (1, docs[1][1])]
    frame = docs_frame(docs).selectExpr("*", "1 as item_ids", "2 as starts")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_items(frame, bench, carry=["doc_id", "text", "item_ids"]).collect()
    assert len(got) == len(docs)
    for r in got:
        want = {}
        for i, t in items:
            p = plain(t or "")
            if p and len(r.row.text or "") < 10_000:
                d, _ = brute_search(p, plain(r.row.text or ""))
                if d <= max(0, len(p) // 16 - 1):
                    want[i] = d
        if len(r.row.text or "") < 10_000:
            assert dict(zip(r.item_ids, r.distances)) == want
        for i, d, a, b in zip(r.item_ids, r.distances, r.starts, r.ends):
            span = (r.row.text or "").encode()[a:b]
            if d == 0:
                assert plain(span.decode()) == plain(dict(items)[i])
    assert [r.item_ids for r in got if r.row.doc_id == 103] == [[3]]


def test_empty_tables(spark, docs_frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.item_ids for r in find_items(docs_frame([(1, "a b c")]), none).collect()] == [[]]
    assert find_items(docs_frame([]), spark.createDataFrame([(1, "some text")], "item_id long, text string")).collect() == []


def test_query_finds_every_planted_item(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: set(r.item_ids) for r in queries.op3_decontaminate(spark, d).collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    found = 0
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        text = plain(r.text)
        exact = {i for i, t in items.items() if t in text}
        assert exact <= got[r.doc_id]
        found += bool(exact)
    assert found and np.mean([bool(v) for v in got.values()]) < 0.2
