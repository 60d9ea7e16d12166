from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from lakecairn.llm import registry, sketch
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, out):
    rows = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = [r.text or "" for r in rows]
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for i, r in enumerate(rows):
        t, after, g = texts[i], texts[(i + 1) % len(rows)], got[r.doc_id]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert g.n_chars == len(t)
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        for est, true, n in ((g.near_edited, like(a, b), len(a | b)), (g.near_next, like(a, c), len(a | c))):
            assert abs(est - true) < (1e-9 if n <= sketch.K else 0.2)
        assert abs(g.n_shingles_est - len(a)) <= (0 if len(a) < sketch.K else 0.45 * len(a))
        assert (g.fingerprint == g.edited_fingerprint) >= (t == edited)
    same = {}
    for r, t in zip(rows, texts):
        assert same.setdefault(t, got[r.doc_id].fingerprint) == got[r.doc_id].fingerprint


def test_query_equals_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").collect(), registry.op4_fingerprints(spark, SF).collect())


def test_ranges_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.expr("doc_id * doc_id - 50"))
    check(docs.collect(), sketch.fingerprints(docs).collect())
    odd = odd_docs(spark)
    check(odd.collect(), sketch.fingerprints(odd).collect())
    assert sketch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = odd.filter("doc_id = 6")
    assert sketch.fingerprints(one).first().near_next == 1.0
    assert sketch.fingerprints(odd.union(odd)).count() == 2 * odd.count()


def test_ids_far_apart_and_close_together(spark):
    """Ranges stay even with outlying, negative and huge ids."""
    dense = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for far in ([10**12], [-(2**62), 2**62], [2**63 - 1, -(2**63)], []):
        ids = dense.unionByName(spark.createDataFrame([(x,) for x in far], "doc_id long"))
        dealt = sketch.by_ranges(ids).groupBy("own").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("own").collect()
        assert max(r.n for r in dealt) <= sketch.UNEVEN * sketch.RANGE_ROWS and sum(r.n for r in dealt) == 20_000 + len(far)
        assert all(a.hi < b.lo for a, b in zip(dealt, dealt[1:]))
    rows = [(-(2**63), "a b c d e f"), (2**63 - 1, "b c d e f g"), (2**62, "x y"), (-(2**62), "x y z"), (0, None), (3, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("own", "pid", "guard", "first", "to", "sketch", "edited", "next_text", "lo", "before", "_hashes"):
        docs = docs.withColumn(name, F.lit("x"))
    check(docs.collect(), sketch.fingerprints(docs).collect())


def test_parts_merge_into_the_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    parts = sketch.with_sketch(docs.withColumn("g", F.col("doc_id") % 3), "text", "sketch")
    merged = {r.g: r.sketch for r in sketch.merge_parts(parts, "g").collect()}
    for g, rows in parts.toPandas().groupby("g"):
        assert list(merged[g]) == sorted(set().union(*map(list, rows.sketch)))[: sketch.K]
    pair = parts.select("sketch").crossJoin(parts.filter("doc_id = 1").select(F.col("sketch").alias("b"))).withColumn("c", sketch.containment(F.col("sketch"), F.col("b")))
    assert pair.filter("sketch = b and c < 0.99").count() == 0 and pair.filter("c < 0 or c > 1").count() == 0


def test_no_python_on_the_main_path(spark):
    plan = registry.op4_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
