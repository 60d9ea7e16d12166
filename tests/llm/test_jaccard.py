from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecairn.llm import graph, jaccard, registry
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """doc_id to (size, component, links)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(sets, 0)
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, set()).add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), links[i]) for i, s in sets.items()}


def near_copies(seed, n=400):
    """Groups of texts of 1 to 60 words, changed here and there, around the limit of likeness."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    while len(rows) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 40, 60]))]
        for _ in range(rnd.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w) + 1)
                if rnd.random() < 0.4 and len(w) > 1:
                    w.pop(min(k, len(w) - 1))
                else:
                    w.insert(rnd.choice([0, len(w), k]), rnd.choice(vocab))
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows[:n], 10))


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    compare(spark, near_copies(seed))


def test_blocks_boundaries_and_frequent_shingles(spark, monkeypatch):
    rows = near_copies(3, 250)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    compare(spark, rows)
    monkeypatch.setattr(jaccard, "ASKED", 10**9)  # no consensus: whole sets are compared
    monkeypatch.setattr(jaccard, "MOST_SETS", 2)
    compare(spark, rows)
    monkeypatch.setattr(jaccard, "ASKED", 4)
    monkeypatch.setattr(jaccard, "VOLUME", 100)
    compare(spark, rows)
    monkeypatch.setattr(jaccard, "boundary", lambda counts: 0)
    compare(spark, rows)
    monkeypatch.setattr(jaccard, "boundary", lambda counts: 14)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 0)
    compare(spark, rows)


def test_repeated_ids(spark):
    """Rows of one id are one document: 9 reaches 5 through the two rows of 7."""
    a, c = "a b c d e f g h i j k l m n o p", " ".join(f"c{i}" for i in range(40))
    rows = [(5, a), (7, a), (7, c), (9, c + " more"), (11, "on its own here"), (None, a), (7, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == [(-1, 12, 5), (5, 12, 5), (7, 12, 5), (7, 12, 5), (7, 36, 5), (9, 37, 5), (11, 1, 11)]
    far = [(-(2**63), c), (2**63 - 1, c + " more"), (0, a)]
    assert {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(far, "doc_id long, text string")).collect()} == {-(2**63): -(2**63), 2**63 - 1: -(2**63), 0: 0}


def test_clashing_columns(spark):
    names = ["n", "k1", "k2", "first", "copies", "component", "part", "row", "kind", "tokens", "block", "node"]
    df = spark.createDataFrame(near_copies(6, 80), "doc_id long, text string")
    wide = df.select("*", *[F.lit("x").alias(c) for c in names])
    rows = lambda d: sorted(map(tuple, jaccard.join(d).collect()))
    assert rows(wide) == rows(df)


def test_chains_go_on_over_chunks(monkeypatch):
    """Chains met piece by piece join up the same documents as all at once."""
    rng = np.random.default_rng(5)
    token, n, doc = rng.integers(0, 6, 300), rng.integers(1, 60, 300), rng.permutation(300)
    order = np.lexsort((n, token))
    token, n, doc = token[order], n[order], doc[order]

    def joined(bound):
        monkeypatch.setattr(jaccard, "VOLUME", bound)
        rows = [jaccard._postings(token[i : i + 7], n[i : i + 7], n[i : i + 7], doc[i : i + 7], None) for i in range(0, 300, 7)]
        up = list(range(300))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for out in jaccard._reduce(iter(rows)):
            for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()):
                a, b = sorted((root(a), root(b)))
                up[b] = a
        return [root(x) for x in range(300)]

    assert joined(20) == joined(10**6) and len(set(joined(20))) > 3


def test_differences_count_like_whole_sets():
    """Overlaps from differences to any set are those of the sets themselves."""
    rng = np.random.default_rng(9)
    base = rng.choice(1000, 60, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 54, replace=False), rng.choice(1000, rng.integers(0, 6))])) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    doc, block, copies = rng.permutation(40), np.arange(40) % 2, rng.integers(1, 4, 40)
    for across in (False, True):
        found = []
        for most in (np.zeros(0, np.int64), jaccard.consensus(sets), sets[3]):
            held = [jaccard.difference(s, most) for s in sets]
            found.append([x.tolist() for x in jaccard._compare(doc, block, across, copies, n, np.concatenate(held), np.concatenate([[0], np.cumsum([len(s) for s in held])]))])
        assert found[0] == found[1] == found[2] and sum(found[0][1]) > 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in registry.op3_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark):
    out = jaccard.join(odd_docs(spark)).collect()
    assert len(out) == 11
    got = {r.doc_id: r for r in out}
    for i in (1, 2, 3):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (0, i, 0)
    assert got[5].component_id == 4 and got[7].component_id == 6 and got[10].n_shingles == 1
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0


def test_every_pair_within_reach_shares_enough():
    for a in range(1, 60):
        for b in jaccard.partner_sizes(a):
            c = jaccard.must_share(a, b)
            assert 100 * c >= 80 * (a + b - c) and not 100 * (c - 1) >= 80 * (a + b - c + 1)
    assert jaccard.boundary({}) == 0 and 0 < jaccard.boundary(dict.fromkeys(range(1, 41), 10)) <= jaccard.LARGEST_SMALL


@pytest.mark.parametrize("bound", [0, 10_000])
def test_components_of_a_long_chain(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", bound)
    edges = spark.range(300).select(F.pmod(F.col("id") * 7919, F.lit(300)).alias("a"), F.pmod((F.col("id") + 1) * 7919, F.lit(300)).alias("b")).filter("id <> 150")
    assert {r.component for r in graph.components(edges).collect()} == {0}
    assert graph.components(edges.limit(0)).count() == 0
