from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from churnscope.llm import merkle_manifest, queries
from churnscope.llm.merkle_manifest import field, digest, fold, manifest, proof_digest
from pyspark.sql import functions as F

NAMES = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES])


def tree(digests):
    """(root, siblings of each leaf per level as (left, right) lists)."""
    paths = [[] for _ in digests]
    members = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(a, min(a + 3, len(digests))) for a in range(0, len(digests), 3)]
        for run in runs:
            for j in run:
                for leaf in members[j]:
                    paths[leaf].append(([digests[k] for k in run if k < j], [digests[k] for k in run if k > j]))
        members = [[leaf for j in run for leaf in members[j]] for run in runs]
        digests = [sha(*[digests[j] for j in run]) for run in runs]
    return digests[0], paths


def brute(rows):
    """doc rows -> list of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by[s]])
    root, tops = tree([trees[s][0] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(by[s], trees[s][1]):
            path = path + top
            proof = sha(*[d for left, right in path for d in left + right])
            node = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                node = leaf_of({**r, "text": None if r["text"] is None else r["text"].replace("\n", "")})
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((r["doc_id"], leaf_of(r), trees[s][0], root, proof, node, node == root))
    return out


def as_sorted(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equals_brute_force(spark, monkeypatch, levels):
    """One to several rounds; NULLs in every column, ties, repeated rows, a hot
    source, sources of one row, an extra column."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 3**levels)
    rng = random.Random(levels)
    rows = [(i, rng.choice(["hot", "hot", "b", "é", None]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "x\ny", "line\n" * 9])) for i in range(130)]
    rows += [(7, "b", None, 1, "tie"), (7, "b", None, 1, "tie"), (7, "b", None, 1, "other"), (None, "b", None, None, None), (None, None, None, None, "a\n")]
    rows += [(500 + i, f"own{i}", "en", 3, "abc") for i in range(11)] + [(900, "long", "en", 1, "wort\n" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as idx", "'x' as path")
    got = queries.merkle_rows(frame.repartition(3)).collect()
    want = brute([dict(zip(NAMES, r)) for r in rows])
    assert as_sorted(tuple(r) for r in got) == as_sorted(want)
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_small_sizes(spark, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    got = queries.merkle_rows(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert as_sorted(tuple(r) for r in got) == as_sorted(brute([dict(zip(NAMES, r)) for r in rows]))


def test_interface_gives_paths(spark):
    frame = spark.range(40).selectExpr("cast(id % 3 as string) as source", "id as doc_id", "id * 2 as more")
    rows = frame.withColumn("leaf", digest(field(F.col("doc_id"))))
    found = manifest(rows).withColumns({"again": fold(F.col("leaf"), F.col("path")), "proof": proof_digest(F.col("path"))}).collect()
    assert len(found) == 40 and all(r.again == r.root and r.more == 2 * r.doc_id for r in found) and len({r.root for r in found}) == 1
    assert {len(r.path) for r in found} == {4}


def test_sql_equals_the_query(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    frame = queries.op11_merkle_manifest(spark, d)
    want = con.execute(f"select {', '.join(frame.columns)} from ({queries.llm_oracles()['op11_merkle_manifest']})").fetchall()
    assert as_sorted(want) == as_sorted(tuple(r) for r in frame.collect())
    assert as_sorted(want) == as_sorted(brute([r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]))
