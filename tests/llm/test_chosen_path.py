from __future__ import annotations

import random
import re

import numpy as np
import pytest

from churnscope.llm import chosen_path, queries
from churnscope.llm.chosen_path import near_duplicates, runs
from churnscope.llm.components import components


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return a == b or (a and b and len(a & b) / len(a | b) >= 0.8)


def brute(rows):
    """Class (as a set of row numbers) and links of each row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def corpus(seed, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.6:
            texts.append(" ".join([word() for _ in range(rng.randint(5, 60))] + passage))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice([1, 4, 5, 6, 40, 90]))))
    base = [word() for _ in range(60)]
    for _ in range(40):  # one large group of different near copies
        w = list(base)
        w[rng.randrange(60)] = word()
        texts.append(" ".join(w))
    return texts


def check(got, rows):
    want_class, want_links = brute(rows)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    members = {}
    for (i, _), c in zip(rows, want_class):
        members.setdefault(c, []).append(i)
    for (i, _), c, k in zip(rows, want_class, want_links):
        assert (by_id[i].class_id, by_id[i].class_size, by_id[i].n_links) == (min(members[c]), len(members[c]), k)


@pytest.mark.parametrize("seed,limit,block,levels", [(1, 8192, 1024, 3), (2, 8192, 7, 3), (3, 30, 16, 2)])
def test_equals_brute_force(spark, docs_frame, monkeypatch, seed, limit, block, levels):
    monkeypatch.setattr(chosen_path, "LIMIT", limit)
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", block)
    monkeypatch.setattr(chosen_path, "LEVELS", levels)
    monkeypatch.setattr(chosen_path, "RECALL", 0.99999)
    rows = list(enumerate(corpus(seed)))
    got = near_duplicates(docs_frame(rows).selectExpr("*", "1 as rep", "2 as n", "3 as bucket")).collect()
    check(got, rows)


def test_nulls_copies_and_empty_table(docs_frame):
    long = "word " + " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, long), (7, long + " end"), (8, "solo")]
    check(near_duplicates(docs_frame(rows)).collect(), rows)
    twice = near_duplicates(docs_frame([(None, "a b"), (9, "a b"), (9, "a b"), (None, "z")])).collect()
    assert sorted((r.class_id or -1, r.class_size, r.n_links) for r in twice) == [(-1, 1, 0), (9, 3, 2), (9, 3, 2), (9, 3, 2)]
    assert near_duplicates(docs_frame([])).collect() == []


def test_runs_follow_the_recall():
    assert runs(0.9) < runs(0.999) and (1 - np.exp(-1.2)) > 0.6


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(131, 115)]
    random.Random(1).shuffle(edges)
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 131: 100}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(queries.op2_chosen_path(spark, d).collect(), rows)


def test_pairs_in_split_buckets_are_found(docs_frame, monkeypatch):
    """Texts of shared passages only: their buckets are all over the limit."""
    monkeypatch.setattr(chosen_path, "LIMIT", 12)
    monkeypatch.setattr(chosen_path, "runs", lambda *_, f=runs: f(0.99))
    monkeypatch.setattr(chosen_path, "more_runs", lambda *_, f=getattr(chosen_path, "more_runs", None): f(0.99), raising=False)
    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(30)) for k in range(12)]
    texts = []
    for _ in range(90):
        text = " ".join(rng.sample(passages, 5))
        w = text.split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts += [text, " ".join(w)]
    rows = list(enumerate(texts))
    _, want = brute(rows)
    got = {r.doc_id: r.n_links for r in near_duplicates(docs_frame(rows)).collect()}
    assert all(got[i] <= k for i, k in enumerate(want))
    assert sum(got.values()) >= 0.98 * sum(want) > 0


def test_recall_holds_over_all_levels():
    kept = (1 - np.exp(-0.8 * chosen_path.BRANCH)) ** chosen_path.LEVELS
    n = chosen_path.runs() + chosen_path.more_runs()
    assert np.exp(-0.8 * chosen_path.BRANCH * chosen_path.runs()) + (1 - kept) ** n <= (1 - chosen_path.RECALL) * (1 + 1e-9)


def test_wide_buckets_are_compared_by_size(docs_frame, monkeypatch):
    """Texts of many sizes that share a passage: a set goes to the comparisons
    of its size, not to all blocks of its buckets."""
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 8)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(8))
    texts = [" ".join([passage, *(f"w{rng.randrange(10**6)}" for _ in range(10 + 3 * k))]) for k in range(100)]
    texts += [t + " end" for t in texts[::10]]
    rows, plans = list(enumerate(texts)), []
    monkeypatch.setattr(chosen_path, "_shares", lambda members, f=chosen_path._shares: plans.append(f(members)) or plans[-1])
    check(near_duplicates(docs_frame(rows)).collect(), rows)
    sent = [r.rest_blocks + r.first_blocks if r.rest else r.rest_blocks for r in plans[0].collect()]
    assert max(sent) <= 6


def test_size_bands_part_no_similar_pair(spark):
    sizes = sorted({n for k in range(1, 400) for n in (4 * k, 5 * k)})
    level = spark.createDataFrame([(n, n, 0, 1) for n in sizes], "rep long, n int, run int, bucket long")
    bands = {}
    for r in chosen_path._size_bands(level).collect():
        bands.setdefault(r.rep, set()).add(r.bucket)
    assert all(bands[4 * k] & bands[5 * k] for k in range(1, 400)) and not bands[100] & bands[200]
