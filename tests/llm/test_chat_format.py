from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from churnscope.llm import chat_format, queries
from churnscope.llm.chat_format import conversations, escape, format_conversations, learned_texts, loss_mask, parse, render, unescape
from churnscope.llm.storage import stored

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    SPEC = f.read()
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<\\|", "<\\\\|x", "<", "|", "\\", "<|", "<|endoftext|>"]


def digests(turns):
    """What the query returns for (role, text) turns, worked out directly."""
    learned = "".join(t for r, t in turns if r == "assistant")
    joined = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def text(rng):
    return "".join(rng.choice([*CONTROLS, "wörd ", "\n", " ", "🙂", "日本", "a", ".", "é"]) for _ in range(rng.randint(0, 12)))


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    seen = {}
    for _ in range(3000):
        s = text(rng)
        e = escape(s)
        assert unescape(e) == s and "<|" not in e
        assert seen.setdefault(e, s) == s


def test_render_and_mask_give_back_every_turn_and_learned_text():
    rng = random.Random(2)
    tokenizer = chat_format.encoder(SPEC)
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "<|im_sep|>", ""]), text(rng)) for _ in range(rng.randint(0, 6))]
        formatted, spans = render(turns)
        assert parse(formatted) == turns
        e = tokenizer.encode(formatted, add_special_tokens=False)
        token = np.array(e.offsets, np.int64).reshape(-1, 2)
        mask = loss_mask(token, spans)
        plain = [any(a < y and x < b for x, y in spans.tolist()) for a, b in e.offsets]
        assert mask.tolist() == plain
        assert learned_texts(formatted, token, mask) == [t for r, t in turns if r == "assistant" and t]
        assert sum(i >= 50257 for i in e.ids) == 3 * len(turns)
    with pytest.raises(ValueError):
        parse("x" + render([("user", "a")])[0])


@pytest.mark.parametrize("part_chars", [1 << 20, 50])
def test_query_equals_direct_digests(spark, monkeypatch, part_chars):
    """Long conversations are cut into parts; ties, NULLs, repeated rows and an
    extra column with a clashing name."""
    monkeypatch.setattr(chat_format, "PART_CHARS", part_chars)
    monkeypatch.setattr(chat_format, "BATCH_CHARS", 200)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), text(rng) if rng.random() < 0.9 else None) for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(1000, t, ("user", "assistant")[t % 2], "long word é " * 40) for t in range(80)]
    rows += [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (5, None, None, "no turn"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "true as edge", "'x' as formatted")
    low = (float("-inf"),)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1] if r[1] is not None else low[0], r[2] or "", (r[3] or "").encode())):
        want.setdefault(c, []).append((r or "", x or ""))
    parts = stored(format_conversations(frame.repartition(5), SPEC), "chat")
    if part_chars < 100:
        assert parts.where("conv_id = 1000").count() > 10
    got = conversations(parts).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(want[r.conv_id])
        assert r.formatted_chars == len(render(want[r.conv_id])[0])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations(stored(format_conversations(frame, SPEC), "chat")).collect() == []


def test_registered_query_equals_direct_digests(spark):
    d = "/root/testdata/sf0.01"
    want = {-1: [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = queries.op13_chat_format(spark, d).collect()
    assert len(got) == len(want)
    assert all((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(want[r.conv_id]) for r in got)


def test_sql_equals_the_query(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    frame = queries.op13_chat_format(spark, d)
    want = con.execute(f"select {', '.join(frame.columns)} from ({queries.llm_oracles()['op13_chat_format']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in frame.collect())
