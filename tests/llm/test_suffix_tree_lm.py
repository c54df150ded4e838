from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnscope.llm import queries, suffix_tree_lm
from churnscope.llm.suffix_tree_lm import score_documents
from churnscope.llm.text_arrays import mix, unmix


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", lowered), "</end>"]


class Brute:
    """The same model with dictionaries."""

    def __init__(self, train, depth=2, discount=0.75, word_support=2.5e-7, gram_support=1e-6):
        self.depth, self.discount = depth, discount
        self.c1 = Counter(t for d in train for t in d)
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        ok = {(w,) for w, c in self.c1.items() if c >= max(2, math.ceil(word_support * self.n))}
        self.count = {(w,): c for w, c in self.c1.items() if (w,) in ok}
        self.next = {}
        for k in range(2, depth + 2):
            grams = Counter(tuple(d[i : i + k]) for d in train for i in range(len(d) - k + 1) if tuple(d[i : i + k - 1]) in ok and tuple(d[i + 1 : i + k]) in ok)
            ok = {g for g, c in grams.items() if c >= max(2, math.ceil(gram_support * self.n))}
            for g in ok:
                self.count[g] = grams[g]
                self.next.setdefault(g[:-1], {})[g[-1]] = grams[g]
        self.states = {}
        for s in sorted(self.next, key=len):
            n, succ = self.count[s], self.next[s]
            q = {x: self.p(x, s[1:]) for x in succ}
            rest, q_rest = 1 - sum(succ.values()) / n, max(1 - sum(q.values()), 1e-12)
            kl = sum(c / n * math.log(c / n / q[x]) for x, c in succ.items()) + (rest * math.log(rest / q_rest) if rest > 1e-15 else 0)
            if 2 * n * kl > len(succ) * math.log(max(n, 2)):
                taken = sum((c - discount) / n for c in succ.values())
                self.states[s] = ({x: (c - discount) / n for x, c in succ.items()}, max(1 - taken, 1e-12))

    def p(self, x, context):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.c1[x] or self.v) / (self.n + self.v)
        own, rest = self.states[context]
        return own.get(x, 0) + rest * self.p(x, context[1:])

    def score(self, doc):
        return sum(math.log10(self.p(x, tuple(doc[max(0, i - self.depth) : i]))) for i, x in enumerate(doc))


def test_mix_is_invertible():
    x = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    assert (unmix(mix(x)) == x).all()


@pytest.mark.parametrize("flush", [50, 1 << 20])
def test_equals_brute_force(spark, docs_frame, monkeypatch, flush):
    monkeypatch.setattr(suffix_tree_lm, "FLUSH", flush)
    rng = np.random.default_rng(3)
    names = ["Alpha", "beta", "GAMMA", "delta", "eps", "the", "of"]
    rows = [(i, " ".join(names[min(int(rng.exponential(2)), 6)] for _ in range(rng.integers(0, 40))) + f" w{i % 37}") for i in range(150)]
    rows += [(200 + i, "the quick brown fox jumps\nover the lazy dog") for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "the of"), (303, "É é Ünknown"), (5, rows[5][1]), (5, rows[5][1])]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    model = Brute([tokens(t) for i, t in rows if not held(i)])
    frame = docs_frame(rows).selectExpr("*", "1 as score", "2 as range", "3 as row_key")
    flag = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = score_documents(frame, flag).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    assert any(len(s) == 2 for s in model.states)
    for r in out:
        doc = tokens(texts[r.doc_id])
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(doc) and r.train_tokens == model.n
        assert r.n_known == sum(model.c1[t] > 0 for t in doc)
        assert r.base_score == pytest.approx(sum(math.log10((model.c1[t] + 1) / (model.n + model.v + 1)) for t in doc))
        assert r.score == pytest.approx(model.score(doc))


def test_distributions_sum_to_one():
    model = Brute([tokens("a b a b a c"), tokens("a b a b b"), tokens("c a b")] * 4)
    for s in [(), *model.states]:
        assert sum(model.p(x, s) for x in model.c1) + model.p("never", s) == pytest.approx(1)


def test_nothing_to_learn_from_and_empty_table(spark, docs_frame):
    out = score_documents(docs_frame([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    assert score_documents(docs_frame([]), F.lit(False)).collect() == []


def test_query_beats_the_base_on_held_out_texts(spark):
    rows = queries.op1_suffix_tree_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_ngrams_are_stored_in_a_large_corpus(spark, docs_frame):
    """Pairs seen twice among 2.2 million tokens are contexts and successors."""
    rows = [(i, "x " * 100_000) for i in range(22)]
    rows += [(100 + i, f"one{i % 30} two{i % 30} three{i % 30}") for i in range(90)]
    held = {100 + i for i in range(60, 90)}
    model = Brute([tokens(t) for i, t in rows if i not in held], word_support=0, gram_support=0)
    assert model.n > 2_000_000 and ("one3",) in model.states and model.count[("one3", "two3", "three3")] == 2
    out = {r.doc_id: r.score for r in score_documents(docs_frame(rows), F.col("doc_id") >= 160).collect()}
    for i, text in rows[22:]:
        assert out[i] == pytest.approx(model.score(tokens(text)))


def test_slices_and_replies_are_not_shuffled_again(spark, docs_frame):
    out = score_documents(docs_frame([(i, f"a b c{i % 3}") for i in range(50)]), F.lit(False))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "FlatMapGroupsInPandas" in plan
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_")]
    assert out.count() == 50
