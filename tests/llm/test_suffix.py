from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecairn.llm import registry, suffix
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs


def brute(rows, length=100):
    """rows: (doc_id, text) in order. doc_id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()) if len(data) else 0
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def passages(seed):
    """Texts of shared passages, cut and joined at any place, with periods and very common lines."""
    rnd = random.Random(seed)
    letters = lambda n: "".join(rnd.choice("ab é\n") for _ in range(n))
    pool = [letters(rnd.choice([40, 99, 100, 101, 150, 400])) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            parts.append(rnd.choice([p, p[a:], p[:a], letters(rnd.randint(1, 200)), "Und " * rnd.randint(1, 80), "x" * rnd.randint(1, 250)]))
        rows.append((i * 3, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.hash("doc_id")).repartition(5)
    assert result(suffix.dedup(df)) == brute(rows)


def test_common_lines_and_passages(spark):
    """Anchors known as frequent, inside lines shorter than a window and in passages longer than one."""
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    line, passage = letters(60) + "\n", letters(300)
    rows = []
    for i in range(150):
        rows.append((i, letters(rnd.randint(0, 90)) + rnd.choice([line, line * 2, passage, passage[rnd.randint(0, 99) :], ""]) + letters(rnd.randint(0, 90)) + rnd.choice([line, ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(suffix.dedup(df)) == brute(rows)
    assert df.mapInArrow(suffix._frequent, "gram long, n long").count() > 0


@pytest.mark.parametrize("bytes_held", [1, 2000])
def test_buckets_larger_than_what_a_task_holds(spark, bytes_held):
    rows = passages(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(suffix.dedup(df, anchors_held=3, bytes_held=bytes_held)) == brute(rows)


def test_anchors_settled_in_pieces():
    """What counts as repeated does not depend on how many anchors are held."""
    rng = np.random.default_rng(2)
    gram = np.sort(rng.integers(0, 400, 500))
    doc, state = rng.integers(0, 99, 500), rng.choice([suffix.ALONE, suffix.ALONE, suffix.ALONE, suffix.STANDS], 500).astype(np.int32)
    batches = [suffix._record(suffix.FOUND, gram[i : i + 11], gram[i : i + 11], doc[i : i + 11], state[i : i + 11]) for i in range(0, 500, 11)]
    want = sorted((d, g) for d, g, s in zip(doc.tolist(), gram.tolist(), state.tolist()) if s == suffix.ALONE and ((gram == g).sum() > 1 or (state[gram == g] == suffix.STANDS).any()))
    for held in (1, 2, 17, 10**6):
        got = [x for out in suffix._repeated(held)(iter(batches)) for x in zip(out.column("doc_id").to_pylist(), out.column("gram").to_pylist())]
        assert sorted(got) == want


def test_any_ids(spark):
    """Negative, huge and repeated ids, and columns that are named as columns used inside."""
    rnd = random.Random(8)
    a, b, c = ("".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(-5, a), (-5, b + "y"), (2**63 - 1, a[50:] + c), (-(2**63), b), (-4, c), (None, a), (0, a + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "cuts", "key", "gram", "start", "kept", "_id", "_key", "_0", "n_bytes"):
        df = df.withColumn(name, F.lit("x"))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.dedup(df).collect() if r.doc_id is not None)
    assert got == [(-(2**63), 300, 0), (-5, 300, got[1][2]), (-5, 301, got[2][2]), (-4, 300, 0), (0, 301, 300), (2**63 - 1, 550, 550)]
    assert sorted(x[2] for x in got[1:3]) == [0, 300]
    one = suffix.dedup(df.filter("doc_id <> -5"), carry=("row", "_id"))
    assert [c for c in one.columns if c in ("row", "_id")] == ["row", "_id"] and {(r.row, r["_id"]) for r in one.collect()} == {("x", "x")}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert result(registry.op10_suffix_dedup(spark, SF)) == brute([(r.doc_id, r.text) for r in docs])


def test_segments_of_a_long_document(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(3000)
    long = word(600_000) + shared + word(700_000) + shared[5:2500]
    rows = [(1, long), (2, "z" + shared), (3, "x" * 40)]
    assert result(suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = result(suffix.dedup(docs))
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None][:3] == (17, 0, 0) and got[7][1] == got[7][0]
    twice = suffix.dedup(docs.filter("doc_id = 6").unionByName(docs.filter("doc_id = 6"))).collect()
    assert len(twice) == 2 and {r.doc_id for r in twice} == {6} and {r.n_removed == r.n_bytes for r in twice} == {True, False}
    assert suffix.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_refinement_orders_by_equal_strings():
    rnd = np.random.default_rng(3)
    flat = rnd.integers(97, 99, 4000).astype(np.uint8)
    flat[2000:2300] = flat[100:400]
    grams = np.array([hash(flat[i : i + 25].tobytes()) for i in range(len(flat))], np.int64).view(np.uint64)
    at = np.arange(len(flat) - 100)
    p = suffix.refine(grams, 25, at, 100)
    groups = {}
    for i in at:
        groups.setdefault(flat[i : i + 100].tobytes(), []).append(i)
    for where in groups.values():
        assert len({int(p[i]) for i in where}) == 1 and (p[where[0]] == -1) == (len(where) == 1)
