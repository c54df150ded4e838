"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole with a template in which every turn is

    <|im_start|>role<|im_sep|>text<|im_end|>

and encoded once, with offsets; the three control strings are special tokens
of the encoding.  A token is under the loss mask if its span meets the span of
a text that the model is to learn (by default the assistant's); the spans of
both kinds are sorted, so a binary search finds the turn of each token.

Inside roles and texts, control strings cannot occur: every ``<``, any number
of backslashes, ``|`` gets one more backslash, and loses it again when it is
read.  What was ``<|im_end|>`` stays text, ``<\\|im_end|>``, in the output.

Data path: rows are range-partitioned by (conversation, turn), sorted, and
streamed, so a conversation of any size passes without being gathered.  One
that has more than ``PART_CHARS`` characters, or lies across two partitions,
is written as several parts, cut between turns; since control tokens end every
turn, the parts' tokens are those of the whole.  ``edge`` marks parts that may
not be the whole conversation: ``conversations`` brings only those together, in
order, and streams them too (a digest of a whole conversation is a sequential
thing, so the parts of one conversation are digested by one task, one part in
memory at a time).

Defined cases: a NULL text or role is empty; turns follow by (turn, role,
text), NULL first, so ties and repeated rows have a fixed order and each is a
turn; rows with a NULL conversation id are one conversation; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.storage import arrow_columns, arrow_fields

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PART_CHARS = 1 << 18
BATCH_CHARS = 1 << 18

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile("".join((re.escape(OPEN), "(.*?)", re.escape(SEP), "(.*?)", re.escape(CLOSE))), re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, np.ndarray]:
    """The formatted conversation and the (start, end) spans of the texts whose
    role is ``learn``, empty ones left out."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + SEP, escape(text)
        if role == learn and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def loss_mask(token_spans: np.ndarray, turn_spans: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the sorted, disjoint ``turn_spans``."""
    if not len(turn_spans):
        return np.zeros(len(token_spans), bool)
    turn = np.searchsorted(turn_spans[:, 1], token_spans[:, 0], side="right")
    inside = turn < len(turn_spans)
    inside[inside] = turn_spans[turn[inside], 0] < token_spans[inside, 1]
    return inside


def learned_texts(formatted: str, token_spans: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one per run of masked tokens, unescaped.
    Tokens of one character split in two overlap, and count once."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [unescape(formatted[a:b]) for a, b in zip(token_spans[first, 0].tolist(), token_spans[last, 1].tolist())]


@lru_cache(maxsize=2)
def encoder(spec: str):
    """The tokenizer of a JSON specification with the control strings as special
    tokens (numbered after its vocabulary) and offsets that keep white space."""
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([OPEN, SEP, CLOSE])
    return tokenizer


_PART = (
    "part long, edge boolean, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
)


def format_conversations(
    rows: DataFrame, spec: str, learn: str = "assistant",
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Parts of formatted conversations: ``conv_id``, ``part`` (ascending within
    a conversation), ``edge``, ``n_turns``, ``formatted``, and per token its id,
    its span of characters and whether it is learned.  Write it before reading:
    the part numbers belong to one run."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ordered = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    made = arrow_fields(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(spec)
        number = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # (conv_id, edge, turns)
        size = 0

        def encoded() -> pa.RecordBatch:
            nonlocal number, size
            out = []
            for _, edge, turns in waiting:
                formatted, spans = render(turns, learn)
                e = tokenizer.encode(formatted, add_special_tokens=False)
                token = np.array(e.offsets, np.int32).reshape(-1, 2)
                out.append((number, edge, len(turns), formatted, np.array(e.ids, np.int32), token[:, 0], token[:, 1], loss_mask(token, spans)))
                number += 1
            ids = pa.array([c for c, _, _ in waiting], key_type)
            waiting.clear()
            size = 0
            return pa.RecordBatch.from_arrays([ids, *arrow_columns(out, made)], ["conv_id", *made.names])

        now, key_type, turns, chars, edge = None, None, [], 0, True
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, role, content in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and (conv != now or chars > PART_CHARS):
                    split = conv == now
                    waiting.append((now, edge or split, turns))
                    size, turns, chars, edge = size + chars, [], 0, split
                    if size > BATCH_CHARS:
                        yield encoded()
                now = conv
                turns.append((role, content))
                chars += len(role) + len(content)
        if turns:
            waiting.append((now, True, turns))
        if waiting:
            yield encoded()

    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_PART}")


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(made: pa.Schema):
    """Streams the parts of conversations, those of one behind each other."""

    def closed(c: list) -> tuple:
        return c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key_type = None, None
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            done = []
            for i in range(batch.num_rows):
                conv, formatted = batch.column("conv_id")[i].as_py(), batch.column("formatted")[i].as_py()
                spans = np.stack([batch.column(c)[i].values.to_numpy() for c in ("starts", "ends")], axis=1)
                mask = batch.column("loss")[i].values.to_numpy(zero_copy_only=False)
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(closed(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, learned = parse(formatted), "".join(learned_texts(formatted, spans, mask))
                now[1] += len(turns)
                now[2].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                now[3] += len(learned)
                now[4].update(learned.encode())
                now[5] += len(formatted)
            if done:
                yield _digest_batch(done, key_type, made)
        if now is not None:
            yield _digest_batch([closed(now)], key_type, made)

    return run


def _digest_batch(rows: list[tuple], key_type: pa.DataType, made: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], key_type), *arrow_columns([r[1:] for r in rows], made)], ["conv_id", *made.names]
    )


def conversations(parts: DataFrame) -> DataFrame:
    """What written ``format_conversations`` parts hold, read from the formatted
    text and the masks: per conversation its turns and their digest, the learned
    text's length and digest, and the length of the formatted text."""
    schema = f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, {_DIGESTS}"
    columns = ["conv_id", "formatted", "starts", "ends", "loss"]
    whole = parts.where("not edge").select(*columns)
    cut = parts.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    read = _read(arrow_fields(_DIGESTS))
    return whole.mapInArrow(read, schema).unionByName(cut.mapInArrow(read, schema))
