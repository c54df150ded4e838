"""SentencePiece encoding with byte spans of the original text, and decoding.

Method.  A text is normalised as the model file says: at each position the
longest prefix found in the model's compiled character map (a double-array
trie over UTF-8 bytes) is replaced, else one character is copied; white space
is escaped to U+2581 and a dummy prefix is put in front.  While doing so,
every normalised byte records the original byte where its source begins.  The
normalised text is segmented by the sentencepiece library, and each piece's
normalised bytes are projected through the record to a span of the original.

Plain models.  A model with byte fallback and no character map or user-defined
symbols, which puts a dummy prefix in front, keeps all spaces and has a piece for
U+2581, only turns each space into that.  Of a text without that character, every piece then has a fixed
number of original bytes, and the spans are sums of these: no record is kept.
Either way the ids are the library's, of the whole text.

Scale: one pass of ``mapInArrow``, no shuffle; memory holds a slice of about
one megabyte of text.  The model file (fixed size, a parameter) travels with the
task.

Defined cases: NULL and empty texts give no ids, no spans and an empty
decoded text; an empty table gives no rows; a very long text is one slice.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import arrow_columns, arrow_fields
from churnscope.llm.text_arrays import slices

SPACE = "▁"
SLICE_BYTES = 1 << 20


class CharMap:
    """The compiled character map of a model: trie size (uint32), trie units
    (uint32 each), then the replacement strings, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest prefix at ``at``."""
        if not self.units:
            return None
        unit = self.units[0]
        node, found = (unit >> 10) << ((unit & 0x200) >> 6), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@dataclass
class Encoded:
    """One text: ids, the [start, end) original bytes of each piece, and what
    the library decodes the ids to."""

    ids: list[int]
    ids_text: str
    starts: np.ndarray
    ends: np.ndarray
    decoded: str


class PieceCodec:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        norm = proto.normalizer_spec
        self.chars = CharMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.symbols = sorted((p.piece.encode() for p in proto.pieces if p.type == 4), key=len, reverse=True)
        self.width = [1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces]
        # of original bytes, where each U+2581 stands for a space
        self.bytes = np.array([1 if p.type == 6 else len(p.piece.replace(SPACE, " ").encode()) for p in proto.pieces], np.int64)
        self.number = [str(i) for i in range(len(proto.pieces))]
        self.plain = (
            proto.trainer_spec.byte_fallback and not self.symbols and not self.chars.units
            and self.dummy and self.escape and not self.squeeze and not self.suffix
            and any(p.piece == SPACE and p.type == 1 for p in proto.pieces)
        )

    # -- normalisation -------------------------------------------------
    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, original byte of each of them and of the end)."""
        out, origin, at, n = bytearray(), [], 0, len(text)

        def prefix(at: int) -> tuple[bytes, int]:
            for s in self.symbols:
                if text.startswith(s, at):
                    return s, len(s)
            return self.chars.longest(text, at) or (text[at : at + (w := _width(text[at]))], w)

        def put(piece: bytes, source: int) -> None:
            if self.escape:
                piece = piece.replace(b" ", SPACE.encode())
            out.extend(piece)
            origin.extend([source] * len(piece))

        if self.squeeze:
            while at < n and prefix(at)[0] == b" ":
                at += prefix(at)[1]
        if at >= n:
            return b"", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            put(b" ", at)
        after_space = self.squeeze
        while at < n:
            piece, used = prefix(at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                put(piece, at)
                after_space = self.squeeze and piece.endswith(b" ")
            at += used
        if self.squeeze:
            space = SPACE.encode() if self.escape else b" "
            while out.endswith(space):
                at = origin[-1]
                del out[-len(space) :], origin[-len(space) :]
        if self.dummy and self.suffix:
            put(b" ", at)
        return bytes(out), np.array([*origin, at], np.int64)

    # -- segmentation --------------------------------------------------
    def encode(self, text: str) -> Encoded:
        if not text:
            return Encoded([], "", np.zeros(0, np.int64), np.zeros(0, np.int64), "")
        ids = self.library.encode(text)
        ids_text = ",".join([self.number[i] for i in ids])
        if self.plain and SPACE not in text:
            ends = np.cumsum(self.bytes[np.array(ids, np.int64)]) - 1  # the dummy prefix has no original byte
            if ends[-1] != len(text.encode()):
                raise ValueError("pieces do not add up to the text")
            starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
        else:
            normal, origin = self.normalise(text.encode())
            unknown = self.library.unk_id()
            bounds = np.zeros(len(ids) + 1, np.int64)
            if unknown in ids:  # a run of unknown characters is one piece: ask the library
                surfaces = self.library.encode(text, out_type=str)
                bounds[1:] = np.cumsum([1 if self.library.is_byte(i) else len(s.encode()) for i, s in zip(ids, surfaces)])
            else:
                bounds[1:] = np.cumsum([self.width[i] for i in ids])
            if bounds[-1] != len(normal):
                raise ValueError("pieces do not add up to the normalised text")
            starts, ends = origin[bounds[:-1]], origin[bounds[1:]]
        return Encoded(ids, ids_text, starts, ends, self.library.decode(ids))


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    """One codec per worker and model."""
    return PieceCodec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def map_encoded(
    docs: DataFrame, model: bytes, finish: Callable[[Encoded], tuple], fields: str,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and ``fields`` (a DDL string), which ``finish`` makes of each
    document's encoding."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()
    made = arrow_fields(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_codec = codec(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                rows = [finish(piece_codec.encode(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrow_columns(rows, made)], ["doc_id", *made.names]
                )

    return source.mapInArrow(run, f"doc_id {key_type}, {fields}")


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) per document: token ids, their byte
    spans in the original text, and the decoded text."""
    return map_encoded(
        docs, model,
        lambda e: (np.array(e.ids, np.int32), e.starts, e.ends, e.decoded),
        "ids array<int>, starts array<long>, ends array<long>, decoded string", id_col, text_col,
    )
