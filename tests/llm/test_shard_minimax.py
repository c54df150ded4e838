from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from churnscope.llm import shard_minimax
from churnscope.llm.shard_minimax import shard_documents


def best_capacity(sizes, shards):
    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("slices", [8, 1 << 15])
def test_largest_shard_is_minimal_and_groups_stay_whole(docs_frame, monkeypatch, slices):
    monkeypatch.setattr(shard_minimax, "SLICES", slices)
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 400) + str(rng.randrange(60))) for i in range(700)]
    rows += [(1000 + i, "copy " * 30) for i in range(90)]
    out = shard_documents(docs_frame(rows), shards=7).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        text = dict(rows)[r.doc_id]
        assert r["size"] == len(text) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        by.setdefault(hashlib.md5(text.encode()).hexdigest(), set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    group = {}
    for _, text in rows:
        d = hashlib.md5(text.encode()).hexdigest()
        group[d] = group.get(d, 0) + len(text) + 1
    load = {}
    for r in out:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) == best_capacity([group[d] for d in sorted(group)], 7)
    for s in load:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_nulls_repeats_empty_and_other_columns(spark, docs_frame):
    rows = [(1, None), (2, ""), (2, ""), (None, "é"), (3, "long " * 50_000)]
    frame = docs_frame(rows).selectExpr("*", "1 as shard", "2 as slot", "3 as size", "4 as digest", "5 as bucket")
    out = shard_documents(frame, shards=2).collect()
    assert len(out) == 5 and {r["size"] for r in out if r.doc_id in (1, 2)} == {1}
    assert len({r.shard for r in out if r.doc_id in (1, 2)}) == 1
    assert [r["size"] for r in out if r.doc_id is None] == [3]
    assert shard_documents(docs_frame([])).collect() == []
    assert shard_documents(docs_frame([(1, "only")])).collect()[0].shard == 0
