from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from churnscope.llm import queries, spelling_variants
from churnscope.llm.spelling_variants import forms, near_words, word_counts
from churnscope.llm.storage import stored


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n), all pairs of near lengths."""
    words = sorted(counts)
    near_of = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for length, ws in by.items():
        for i, a in enumerate(ws):
            for b in ws[i + 1 :] + by.get(length + 1, []):
                if near(a, b):
                    near_of[a].append(b)
                    near_of[b].append(a)
    form = {}
    for w in words:
        best = min(near_of[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near_of[w]), counts[form[w]] if form[w] else None)
    return out


def contract_counts(rows):
    """The words of the registered query, by its definition."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def as_dict(rows):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("levels,least", [(24, 7), (1, 7), (24, 2)])
def test_equals_all_pairs(spark, monkeypatch, levels, least):
    """Runs of equal letters, edits at both ends and in the middle, words that
    begin other words, long words, letters beyond ASCII."""
    monkeypatch.setattr(spelling_variants, "LEVELS", levels)
    rng = random.Random(levels + least)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(least, least + 5))) for _ in range(150)]
    base += ["a" * k for k in range(least, least + 6)] + ["lang" * 40, "aab" * 500]
    counts = {}
    for w in base:
        counts[w] = rng.choice([2, 5, 30, 400])
        for _ in range(3):
            i = rng.randint(0, len(w) - 1)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abéz") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]])
            if len(v) >= least:
                counts.setdefault(v, rng.choice([2, 3, 50, 5000]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = near_words(words, least)
    assert as_dict(forms(words, pairs).collect()) == brute(counts)
    assert any(f for f, *_ in brute(counts).values())


def test_chain_of_forms(spark):
    chain = ["abcdefgh"]
    for c in "vwxyz":
        chain.append(chain[-1][: len(chain)] + c + chain[-1][len(chain) + 1 :])
    counts = {w: 10 ** (k + 1) for k, w in enumerate(chain)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_dict(forms(words, near_words(words)).collect()) == brute(counts)
    assert brute(counts)[chain[0]][1] == chain[-1]


def test_word_counts(spark, docs_frame):
    rows = [(1, "Straße straße ÄPFELN äpfeln naïveté×÷ß"), (None, None), (2, ""), (3, "kurz " * 9 + "Überlänge" * 30_000), (3, "x" * 7), (3, "x" * 7)]
    found = {r.word: r.n for r in word_counts(docs_frame(rows).selectExpr("*", "1 as word", "2 as n"), 6).collect()}
    assert found == {"straße": 2, "Äpfeln": 1, "äpfeln": 1, "naïveté×÷ß": 1, ("Überlänge" * 30_000)[:1] + "berlänge" + "Überlänge" * 29_999: 1, "x" * 7: 2}


def test_empty_table(spark, docs_frame):
    words = stored(word_counts(docs_frame([])), "words")
    assert forms(words, near_words(words)).collect() == []


def test_query_equals_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    frame = queries.op12_spelling_variants(spark, d)
    got = frame.collect()
    assert as_dict(got) == brute(contract_counts(rows))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.execute(f"select {', '.join(frame.columns)} from ({queries.llm_oracles()['op12_spelling_variants']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
