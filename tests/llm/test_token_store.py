from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnscope.llm import queries, storage, token_store
from churnscope.llm.token_store import Encoder, build_hash, numbers, read_spec, write_store

SPEC = read_spec(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_str(SPEC)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \t\n'abcsd1éÉ日🙂!.<|²ªµ×\xa0\x85\x1c\u2028ǀ٣\u0301", max_size=40))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(Encoder(SPEC).encode([text])[0], np.uint16).tolist() == library(text)


def test_special_token_text_and_full_table(monkeypatch):
    text = "a <|endoftext|> b"
    assert np.frombuffer(Encoder(SPEC).encode([text])[0], np.uint16).tolist() == library(text)
    monkeypatch.setattr(token_store, "TABLE_ENTRIES", 3)
    e = Encoder(SPEC)
    for text in ("one two three four five", "six seven one two"):
        assert np.frombuffer(e.encode([text])[0], np.uint16).tolist() == library(text)


def test_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    sizes, bits = build_hash(keys)
    assert sorted(numbers(keys, sizes, bits)) == list(range(len(keys)))


def test_hash_tells_apart_keys_that_share_a_digest(monkeypatch):
    keys, turns = np.arange(2000) % 1000, np.arange(2000) // 1000
    first = token_store._digest

    def clashing(keys, turns, level):  # the first two levels do not see the turns
        return first(keys, turns * (level > 1), level)

    monkeypatch.setattr(token_store, "_digest", clashing)
    sizes, bits = build_hash(keys, turns)
    assert sorted(numbers(keys, sizes, bits, turns)) == list(range(len(keys)))


def test_query_equals_direct_encoding(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op7_token_store(spark, d).collect()}
    table = sorted(pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    assert len(got) == len(table)
    at = 0
    for row in table:
        ids = library(row["text"]) + [2]
        r = got[row["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_keyed_access_nulls_repeats_and_unknown_keys(spark, docs_frame, monkeypatch):
    monkeypatch.setattr(token_store, "CHUNK_IDS", 4)
    frame = docs_frame([(5, "b c"), (5, "a"), (5, "a"), (None, "n"), (-1, None), (9, "x " * 3000)]).selectExpr("*", "1 as key", "2 as shard")
    store = write_store(frame, storage.scratch_path(spark, "t"), SPEC, 2)
    out = store.fetch(store.documents(), lambda i, s, ids: (i, s, ids.tolist()), "doc_id long, start long, ids array<int>").collect()
    rows = sorted(((r.start, r.doc_id, r.ids) for r in out))
    assert [(r[1], r[2]) for r in rows[:5]] == [
        (None, library("n") + [2]), (-1, [2]), (5, library("a") + [2]), (5, library("a") + [2]), (5, library("b c") + [2])
    ]
    assert rows[5][2] == library("x " * 3000) + [2]
    asked = spark.sql("select 5L as key, 2 as turn union all select 77L, 0 union all select 5L, 3")
    got = store.fetch(asked, lambda i, s, ids: (i, ids.tolist()), "doc_id long, ids array<int>").collect()
    assert [(r.doc_id, r.ids) for r in got] == [(5, library("b c") + [2])]


def test_empty_table(spark, docs_frame):
    store = write_store(docs_frame([]), storage.scratch_path(spark, "t"), SPEC, 2)
    assert store.fetch(store.documents(), lambda i, s, ids: (i,), "doc_id long").collect() == []
