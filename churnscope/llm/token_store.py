"""Token ids as raw binary shards with a minimal-perfect-hash index.

File format (a folder that any Spark file system can hold, two Parquet sets):

* ``chunks``: one row per chunk of whole documents in ascending id order:
  ``shard`` (a range of document ids), ``chunk`` (0.. within the shard),
  ``n_docs``, ``n_ids``, ``payload`` (the ids one after the other, little
  endian, 2 or 4 bytes each), ``item_bytes``, and the chunk's directory:
  ``keys`` (the document ids, int64), ``turns`` (0 for the first row with an
  id, 1 for the second, ...: repeated ids are told apart; -1, -2, ... with key
  0 for rows whose id is NULL) and ``lengths`` (ids per document, int64).
* ``index``: one row per hash range of (key, turn): a minimal perfect
  hash of its keys (levels of bit arrays, each key sits in the first level
  where nothing else hits its bit; its number is the count of set bits before
  it), and by that number a 32-bit fingerprint and (shard, chunk, place).

Keyed access hashes the key to its index row, evaluates the function in
constant time, compares the fingerprint and reads one chunk.  Each level hashes
(key, turn) anew, so two keys that fall together in one are told apart by the
next, and none is refused.

Encoding.  Byte-level BPE never merges across its pre-tokens, so a text's ids
are the ids of its pre-tokens; those of frequent ones are kept in a bounded
table per worker, the library's model gives the others.  Only a tokenizer file
of exactly that kind takes this way, any other one is asked for whole texts.

Scale: one range shuffle of the texts by id (ties stay together), then
everything is per partition.  Index ranges hold about ``INDEX_KEYS`` keys, so
their number grows with the documents.  A chunk has about ``CHUNK_IDS`` ids
(one document at least), which bounds a task's memory.

Defined cases: NULL text has no ids but the end id; a NULL id is a key of its
own and comes first; equal ids are kept in the order of their texts; an empty
table gives an empty store.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnscope.llm.storage import arrow_fields, buckets_for
from churnscope.llm.text_arrays import mix, slices

SLICE_BYTES = 1 << 20
CHUNK_IDS = 1 << 18
INDEX_KEYS = 1 << 17
TABLE_ENTRIES = 700_000
GAMMA = 2  # bits per key in a level
_U = np.uint64

# -- encoding ----------------------------------------------------------

# fixed value: the published pattern of byte-level pre-tokens
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII and Latin letters up to U+024F, where letters,
# digits and white space are these ranges.
_LETTERS, _BLANKS = "A-Za-zÀ-ÖØ-öø-ɏ", "\t-\r "
_SIMPLE = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}{_LETTERS}0-9]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
).findall
_OTHER = re.compile(f"[^\x00-\x7f{_LETTERS}]").search


# fixed rule: byte-level models read a byte as a character of its own, the
# printable Latin-1 ones as themselves and the others, in order, from U+0100 on
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHAR = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}


class _Known(dict):
    """Ids of pre-tokens as raw items; the model gives those that are missing,
    and they are kept while there is room."""

    def __init__(self, model, item):
        self.tokenize, self.code = model.tokenize, np.dtype(item).char

    def __missing__(self, word: str) -> bytes:
        tokens = self.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHAR))
        raw = array(self.code, [t.id for t in tokens]).tobytes()
        if len(self) < TABLE_ENTRIES:
            self[word] = raw
        return raw


class Encoder:
    """Ids of texts as the tokenizers library gives them, without special
    tokens being added."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.item = np.uint16 if size <= 1 << 16 else np.uint32
        pre, model = parts.get("pre_tokenizer") or {}, parts["model"]
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.general = None
        if (
            parts.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and model["type"] == "BPE" and not model.get("dropout")
        ):
            import regex

            self.general = regex.compile(PRE_TOKENS).findall
        self.table = _Known(self.library.model, self.item)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.item).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.general(text) if not text.isascii() and _OTHER(text) else _SIMPLE(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as raw little-endian items."""
        if self.general is None or any(s in t for t in texts for s in self.special):
            return self._library(texts)
        find = self.table.__getitem__
        return [b"".join(map(find, self.split(t))) for t in texts]


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


# -- minimal perfect hash ----------------------------------------------


def _digest(keys: np.ndarray, turns: np.ndarray, level: int) -> np.ndarray:
    """A hash of (key, turn) for each level; -1 for the fingerprint."""
    salt = _U((level + 2) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(mix(keys.astype(np.int64).view(_U) + salt) + turns.astype(np.int64).view(_U) * _U(0x632BE59BD9B4E019))


def _fingerprint(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    return (_digest(keys, turns, -1) >> _U(32)).astype(np.uint32)


def _place(keys: np.ndarray, turns: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (_digest(keys, turns, level) % _U(bits)).astype(np.int64)


def build_hash(keys: np.ndarray, turns: np.ndarray | None = None) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all levels' bits as 0/1 bytes) for distinct
    (key, turn)."""
    sizes, levels = [], []
    turns = np.zeros(len(keys), np.int64) if turns is None else turns
    while len(keys):
        bits = max(64, GAMMA * len(keys))
        at = _place(keys, turns, len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        levels.append(alone)
        left = ~alone[at]
        keys, turns = keys[left], turns[left]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def numbers(keys: np.ndarray, sizes: list[int], bits: np.ndarray, turns: np.ndarray | None = None) -> np.ndarray:
    """The number 0..n-1 of each (key, turn); -1 if no level has its bit."""
    turns = np.zeros(len(keys), np.int64) if turns is None else turns
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(bits)))
    out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = _place(keys[todo], turns[todo], level, size) + base
        hit = bits[at]
        out[todo[hit]] = before[at[hit]]
        todo, base = todo[~hit], base + size
    return out


# -- writing -----------------------------------------------------------

CHUNK_FIELDS = (
    "shard int, chunk int, n_docs long, n_ids long, item_bytes int, payload binary, keys binary, turns binary, "
    "lengths binary"
)
INDEX_FIELDS = (
    "range int, n_keys long, level_bits binary, bits binary, fingerprints binary, shards binary, chunks binary, places binary"
)


def _index_range(ranges: int) -> F.Column:
    return F.pmod(F.xxhash64("key", "turn"), F.lit(ranges)).cast("int")


def _encode_partition(spec: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(spec), TaskContext.get().partitionId()
        end = np.array([end_id], enc.item).tobytes()
        chunk, ids, payload, keys, turns = 0, 0, [], [], []
        last, turn = (), 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) // enc.item().itemsize for p in payload], "<i8")
            row = (
                shard, chunk, len(keys), int(lengths.sum()), enc.item().itemsize, b"".join(payload), np.array(keys, "<i8").tobytes(),
                np.array(turns, "<i4").tobytes(), lengths.tobytes(),
            )
            names = [f.split(" ")[0] for f in CHUNK_FIELDS.split(", ")]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist())):
                    turn = turn + 1 if (doc,) == last else 0
                    last = (doc,)
                    payload.append(raw + end)
                    keys.append(doc or 0)
                    turns.append(-1 - turn if doc is None else turn)
                    ids += len(payload[-1]) // enc.item().itemsize
                    if ids >= CHUNK_IDS:
                        yield flush()
                        chunk, ids, payload, keys, turns = chunk + 1, 0, [], [], []
        if keys:
            yield flush()

    return run


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, place, key, turn) of every stored document."""
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], "<i8")
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["chunk"], np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(keys), pa.array(np.frombuffer(r["turns"], "<i4")),
                ],
                ["shard", "chunk", "place", "key", "turn"],
            )


def _index_row(group: pd.DataFrame) -> pd.DataFrame:
    keys, turns = group["key"].to_numpy(), group["turn"].to_numpy()
    sizes, bits = build_hash(keys, turns)
    order = np.empty(len(keys), np.int64)
    order[numbers(keys, sizes, bits, turns)] = np.arange(len(keys))
    by = lambda name: group[name].to_numpy().astype("<i4")[order].tobytes()
    return pd.DataFrame(
        {
            "range": [group["range"].iloc[0]], "n_keys": [len(keys)], "level_bits": [np.array(sizes, "<i8").tobytes()],
            "bits": [np.packbits(bits).tobytes()], "fingerprints": [_fingerprint(keys, turns)[order].astype("<u4").tobytes()],
            "shards": [by("shard")], "chunks": [by("chunk")], "places": [by("place")],
        }
    )


class TokenStore:
    """A written store; see the module's docstring for its format."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.chunks = spark.read.schema(CHUNK_FIELDS).parquet(f"{path}/chunks")
        self.index = spark.read.schema(INDEX_FIELDS).parquet(f"{path}/index")

    def ranges(self) -> int:
        """Hash ranges of the index (recorded in every row's place)."""
        return int(self.index.agg(F.max("range")).first()[0] or 0) + 1

    def starts(self) -> DataFrame:
        """(shard, chunk, chunk_start): ids before each chunk."""
        per_shard = self.chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per id range
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
        within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        return (
            self.chunks.select("shard", "chunk", "n_ids")
            .withColumn("in_shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
            .join(F.broadcast(offsets), "shard")
            .select("shard", "chunk", (F.col("in_shard") + F.col("shard_start")).cast("bigint").alias("chunk_start"))
        )

    def documents(self) -> DataFrame:
        """(key, turn) of every stored document."""
        return self.chunks.select("shard", "chunk", "keys", "turns").mapInArrow(
            _directory, "shard int, chunk int, place int, key long, turn int"
        ).select("key", "turn")

    def locate(self, keys: DataFrame, ranges: int) -> DataFrame:
        """(key, turn, shard, chunk, place) of those of ``keys`` (key, turn)
        that the store has, by the hash index."""

        def find(_: tuple, wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"key": wanted["key"], "turn": wanted["turn"], "shard": 0, "chunk": 0, "place": 0})
            if rows.empty or wanted.empty:
                return out.iloc[:0]
            r = rows.iloc[0]
            sizes = np.frombuffer(r["level_bits"], "<i8").tolist()
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: sum(sizes)].astype(bool)
            keys, turns = wanted["key"].to_numpy(), wanted["turn"].to_numpy()
            number = numbers(keys, sizes, bits, turns)
            known = number >= 0
            known[known] = np.frombuffer(r["fingerprints"], "<u4")[number[known]] == _fingerprint(keys, turns)[known]
            out, number = out[known].copy(), number[known]
            for name in ("shard", "chunk", "place"):
                out[name] = np.frombuffer(r[name + "s"], "<i4")[number]
            return out

        asked = keys.select("key", F.col("turn").cast("int").alias("turn")).withColumn("range", _index_range(ranges))
        return (
            asked.groupBy("range")
            .cogroup(self.index.groupBy("range"))
            .applyInPandas(find, "key long, turn int, shard int, chunk int, place int")
        )

    def fetch(self, keys: DataFrame, finish, fields: str) -> DataFrame:
        """Reads the documents named by ``keys`` (key, turn).  ``finish(doc_id,
        start, ids)`` makes the ``fields`` of a row from each; start counts the
        ids before the document in the whole store."""
        names = arrow_fields(fields).names

        def read(_: tuple, wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if wanted.empty or rows.empty:
                return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
            r = rows.iloc[0]
            ids = np.frombuffer(r["payload"], f"<u{r['item_bytes']}")
            ends = np.cumsum(np.frombuffer(r["lengths"], "<i8"))
            lengths, keys, turns = (np.frombuffer(r[c], t) for c, t in (("lengths", "<i8"), ("keys", "<i8"), ("turns", "<i4")))
            out = [
                finish(None if turns[p] < 0 else int(keys[p]), int(r["chunk_start"] + ends[p] - lengths[p]), ids[ends[p] - lengths[p] : ends[p]])
                for p in wanted["place"].tolist()
            ]
            return pd.DataFrame.from_records(out, columns=names).astype({"doc_id": "Int64"} if "doc_id" in names else {})

        placed = self.chunks.join(self.starts(), ["shard", "chunk"])
        return (
            self.locate(keys, self.ranges()).groupBy("shard", "chunk").cogroup(placed.groupBy("shard", "chunk")).applyInPandas(read, fields)
        )


def write_store(
    docs: DataFrame, path: str, spec: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> TokenStore:
    """Encodes every text with the tokenizer of ``spec`` (its JSON), appends
    ``end_id`` and writes the store to ``path`` in ascending id order."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode_partition(spec, end_id), CHUNK_FIELDS).write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_FIELDS).parquet(f"{path}/chunks")
    n_docs = int(chunks.agg(F.sum("n_docs")).first()[0] or 0)
    ranges = buckets_for(n_docs, INDEX_KEYS, 1)
    entries = chunks.select("shard", "chunk", "keys", "turns").mapInArrow(
        _directory, "shard int, chunk int, place int, key long, turn int"
    )
    (
        entries.withColumn("range", _index_range(ranges))
        .groupBy("range")
        .applyInPandas(_index_row, INDEX_FIELDS)
        .write.parquet(f"{path}/index")
    )
    return TokenStore(spark, path)
