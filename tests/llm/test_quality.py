from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakecairn.llm import langid, quality, registry
from tests.conftest import SF
from tests.llm.helpers import DOCS, is_held_out, odd_docs


def test_held_out_accuracy(spark):
    d = SF.replace("sf0.001", "sf0.01")
    out = registry.op6_quality_classifier(spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert all(out.held_out[i] == is_held_out(i) for i in out.index)
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    held = [i for i in labels.index if is_held_out(i)]
    right = out.predicted.loc[held] == labels.quality.loc[held]
    assert right.mean() > 0.95
    assert right[labels.quality.loc[held] == 0].mean() > 0.8


def test_odd_rows_and_no_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(odd_docs(spark), model).collect()}
    assert out[1] == out[2] == out[3]
    assert out[4] == out[5] and out[6] == out[7]
    empty = quality.train(docs, labels.filter("false"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (quality.train(docs, x.filter(~langid.held_out())) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_ftrl_step_by_step():
    """Each update, and the score, by plain loops over single features."""
    rng = np.random.default_rng(5)
    data = [(np.sort(rng.choice(40, 6, replace=False)).astype(np.int32), rng.random(6), int(rng.random() < 0.4)) for _ in range(30)]
    got = quality.ftrl(data, epochs=2)
    z, n, bias, bias_n = {}, {}, 0.0, 1.0
    ones = sum(y for *_, y in data)
    share = {1: len(data) / (2 * ones), 0: len(data) / (2 * (len(data) - ones))}
    alpha, beta, l1, l2 = 0.3, 1.0, 0.005, 0.02

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return ((1 if z[i] > 0 else -1) * l1 - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(2):
        for j in order.permutation(len(data)):
            idx, val, y = data[j]
            w = {i: weight(i) for i in idx.tolist()}
            p = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in zip(idx.tolist(), val)) + bias)))
            miss = (p - y) * share[y]
            for i, v in zip(idx.tolist(), val):
                g = miss * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += miss * miss
            bias -= 0.05 * miss / bias_n**0.5
    assert np.allclose(got.weights[:40], [weight(i) for i in range(40)]) and not got.weights[40:].any()
    assert abs(got.bias - bias) < 1e-12 and np.count_nonzero(got.weights)


def test_scores_by_plain_loops(spark):
    """The query's operator on a fixed model: features counted one by one."""
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.25)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.score, r.predicted) for r in quality.score(docs, model).collect())
    want = []
    for r in docs.collect():
        buf = np.frombuffer((r.text or "").encode(), np.uint8)
        word, form, _ = quality.hashes(buf, np.array([0, len(buf)]))
        m, found = 0xD6E8FEB86659FD93, []
        mask = (1 << 64) - 1
        found += [int(x) for x in word] + [int(x) for x in form]
        found += [(int(a) * m + int(b) + 3) & mask for a, b in zip(word, word[1:])]
        found += [((int(a) - 2) * m + int(b) - 2 + 4) & mask for a, b in zip(form, form[1:])]
        found += [int(a == b) + 77 for a, b in zip(word, word[1:])]
        at = quality.buckets(np.array(found, np.uint64))
        p = 1 / (1 + np.exp(-(sum(model.weights[i] for i in at.tolist()) * quality.SCALE / max(1, len(found)) + model.bias)))
        want.append(((r.doc_id is None, r.doc_id or 0), p, int(p >= 0.7)))
    want.sort()
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want]) and [x[2] for x in got] == [x[2] for x in want]


def test_clashing_columns_repeated_ids_and_a_bounded_sample(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    plain = quality.train(docs, labels)
    wide = docs
    for c in ("y", "y0", "score", "idx", "val", "n", "quality", "predicted"):
        wide = wide.withColumn(c, F.lit("x"))
    assert (quality.train(wide, labels.withColumn("text", F.lit("x"))).weights == plain.weights).all()
    assert (quality.train(docs.unionByName(docs), labels).weights == plain.weights).all()
    assert quality.score(wide, plain).columns == ["doc_id", "score", "predicted"]
    monkeypatch.setattr(quality, "FEATURES", 2000)
    fewer = quality.train(docs, labels)
    assert 0 < np.count_nonzero(fewer.weights) < np.count_nonzero(plain.weights)
