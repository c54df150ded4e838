from __future__ import annotations

import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from churnscope.llm import queries
from churnscope.llm.piece_codec import CharMap, PieceCodec, encode_documents, read_model

MODEL = read_model(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)

TEXTS = [
    "", " ", "  ", "a", "Hello world", "two  spaces   three", "\n", "\n\nx", " lead", "trail ", "tab\tand\r\nline\n next",
    "naïve café ñandú", "日本語 テキスト", "▁raw ▁mark", "emoji 🙂🙃 x", "a\x00b", "!!! THE!! ###", "a" * 5000, "x \n y\n  z\n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoding_are_the_librarys_and_spans_tile_the_text(text):
    got = PieceCodec(MODEL).encode(text)
    assert got.ids == LIBRARY.encode(text)
    assert got.decoded == LIBRARY.decode(got.ids)
    raw = text.encode()
    if text:
        assert got.starts[0] == 0 and got.ends[-1] == len(raw)
        assert (got.starts[1:] == got.ends[:-1]).all()
    for k, (i, a, b) in enumerate(zip(got.ids, got.starts, got.ends)):
        if not LIBRARY.is_byte(i):
            surface = LIBRARY.id_to_piece(i).replace("▁", " ")
            assert raw[a:b].decode().replace("▁", " ") == (surface if k else surface[1:])


def test_a_text_is_encoded_in_one_call_of_the_library():
    codec, asked = PieceCodec(MODEL), []

    class Counting:
        def __getattr__(self, name):
            return getattr(LIBRARY, name)

        def encode(self, text, **options):
            asked.append(text)
            return LIBRARY.encode(text, **options)

    codec.library = Counting()
    texts = ["some  words that differ\nand a line é 日本", "words that differ", " "]
    assert [codec.encode(t).ids for t in texts] == [LIBRARY.encode(t) for t in texts]
    assert asked == texts


def test_whole_table_query_equals_the_library(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op9_piece_codec(spark, d).collect()}
    table = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    for row in table:
        ids = LIBRARY.encode(row["text"])
        r = got[row["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def trie(words: dict[bytes, int]) -> list[int]:
    """A double-array trie for a few words, by first fit."""
    units, used = [0] * 4096, {0}

    def place(node: int, prefix: bytes) -> None:
        labels = sorted({w[len(prefix)] for w in words if w.startswith(prefix) and len(w) > len(prefix)})
        leaf = prefix in words
        offset = next(o for o in range(1, 3000) if not ({(node ^ o) ^ c for c in labels} | ({node ^ o} if leaf else set())) & used)
        base = node ^ offset
        units[node] |= offset << 10
        if leaf:
            units[node] |= 0x100
            used.add(base)
            units[base] = 0x80000000 | words[prefix]
        used.update(base ^ c for c in labels)
        for c in labels:
            units[base ^ c] |= c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    return units


def mapped_model() -> bytes:
    strings = b"fi\0A\0 \0AB\0"
    units = trie({"ﬁ".encode(): 0, "Ａ".encode(): 3, "\t".encode(): 5, "ＡＢ".encode(): 7})
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.normalizer_spec.precompiled_charsmap = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings
    proto.normalizer_spec.remove_extra_whitespaces = True
    return proto.SerializeToString()


def test_character_map_takes_the_longest_prefix_and_keeps_the_alignment():
    model = mapped_model()
    codec, library = PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert codec.chars.longest("ＡＢc".encode(), 0) == (b"AB", 6)
    assert CharMap(b"").longest(b"x", 0) is None
    for text in ("ﬁne  ＡＢ\tＡx ", "  ﬁ", "plain", "   ", "\t", "Ａ Ａ"):
        got = codec.encode(text)
        assert codec.normalise(text.encode())[0].decode() == library.normalize(text)
        assert got.ids == library.encode(text)
        surfaces = b"".join(text.encode()[a:b] for a, b in zip(got.starts, got.ends))
        assert text.encode().endswith(surfaces) or surfaces in text.encode()
    got = codec.encode("ﬁne Ａ")
    assert got.starts[0] == 0 and got.ends[-1] == len("ﬁne Ａ".encode())


def test_nulls_empty_table_and_other_columns(spark, docs_frame):
    frame = docs_frame([(1, None), (None, "x y"), (2, "x y"), (2, "x y")]).selectExpr("*", "1 as ids", "2 as decoded")
    rows = encode_documents(frame, MODEL).collect()
    assert sorted((r.doc_id is None, r.decoded, len(r.ids)) for r in rows)[0] == (False, "", 0)
    assert sum(r.ids == LIBRARY.encode("x y") for r in rows) == 3
    assert encode_documents(docs_frame([]), MODEL).collect() == []


def test_slices_of_empty_texts_keep_the_schema(docs_frame):
    rows = [(i, "") for i in range(3)] + [(3, "word " * 500_000), (4, ""), (5, "ein Wort " * 150_000)]
    found = {r.doc_id: r for r in encode_documents(docs_frame(rows).coalesce(1), MODEL).collect()}
    assert [len(found[i].ids) for i in (0, 1, 2, 4)] == [0] * 4 and found[3].ends[-1] == 2_500_000 and len(found[5].ids) > 150_000
