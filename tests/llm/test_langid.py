from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakecairn.llm import langid, registry
from tests.conftest import SF
from tests.llm.helpers import DOCS, is_held_out, odd_docs


def test_held_out_accuracy_and_shape(spark):
    out = registry.op1_language_id(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.index)
    assert all(out.held_out[i] == is_held_out(i) for i in out.index)
    held = out[out.held_out]
    assert (held.lang_pred == docs.lang.loc[held.index]).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_odd_rows_and_no_training_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    out = {r.doc_id: r for r in langid.predict(odd_docs(spark), model).collect()}
    for i in (1, 2, 3, 9):
        assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
    assert out[6].lang_pred == out[7].lang_pred and out[6].score == out[7].score
    assert out[4].lang_pred == out[5].lang_pred != "und"
    none = langid.train(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_many_languages_decode_through_one_wrong_bit():
    code = langid.codewords(9)
    assert len({tuple(c) for c in code}) == 9
    model = langid.Model(list("abcdefghi"), code, np.zeros((1, 1)), np.zeros(1))
    margins = code * 3.0
    margins[:, 0] *= -1
    best, score, _, gap = model.decode(margins)
    assert best.tolist() == list(range(9)) and (gap > 0).all() and (score > 0.5).all()


def test_training_ignores_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noisy = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert langid.identify(noisy).filter("lang_pred = 'zz'").count() == 0


def test_predictions_by_plain_loops(spark):
    """Margins, losses and the nearest codeword of a fixed model, n-gram by n-gram."""
    rng = np.random.default_rng(4)
    langs = ["aa", "bb", "cc"]
    code = langid.codewords(3)
    model = langid.Model(langs, code, rng.normal(size=(len(langid.ORDERS) * langid.BUCKETS, code.shape[1])).astype(np.float32), rng.normal(size=code.shape[1]))
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(40), allowMissingColumns=True).filter("length(text) < 3000 or text is null")
    got = {(r.doc_id, r.lang_pred, r.lang_second, round(r.score, 6), round(r.distance, 5)) for r in langid.predict(docs, model).collect() if r.lang_pred != "und"}
    want = set()
    for r in docs.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        raw = bytearray(r.text.encode())
        low = bytearray(b + 32 if 65 <= b <= 90 else b for b in raw)
        for k in range(1, len(low)):
            if low[k - 1] == 0xC3 and 0x80 <= low[k] <= 0x9E and low[k] != 0x97:
                low[k] += 32
        low = bytes(32 if b < 97 or 122 < b < 128 else b for b in low)
        margin, n = np.zeros(code.shape[1]), 0
        for row, size in enumerate(langid.ORDERS):
            for k in range(len(low) - size + 1):
                gram = low[k : k + size]
                if b"  " in gram:
                    continue
                h = 0
                for b in gram:
                    h = (h * 257 + b + 1) % 2**64
                margin += model.weights[int(langid.K.mix(np.array([h], np.uint64))[0] >> np.uint64(49)) + row * langid.BUCKETS]
                n += 1
        margin = margin / max(1, n) + model.bias
        loss = [sum(np.log1p(np.exp(-m * b)) for m, b in zip(margin, word)) for word in code]
        best, second = sorted(range(3), key=loss.__getitem__)[:2]
        score = 1 / sum(np.exp(loss[best] - x) for x in loss)
        want.add((r.doc_id, langs[best], langs[second], round(float(score), 6), round(float(loss[best] / code.shape[1]), 5)))
    assert len(want) > 30
    near = lambda a, b: a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4 and abs(a[4] - b[4]) < 1e-4
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want) and all(near(a, b) for a, b in zip(order(got), order(want)))


def test_a_text_that_is_nearly_all_rows(spark, monkeypatch):
    """Copies are learnt once, wherever they lie, and crowd out no other language; other columns do not matter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    plain = langid.train(docs)
    hot = docs.filter("lang = 'en' and length(text) > 300").limit(1).crossJoin(spark.range(3000)).select("doc_id", "text", "lang")
    crowded = langid.train(docs.unionByName(hot), sample=10**9)
    assert crowded.langs == plain.langs and np.array_equal(crowded.weights, plain.weights)
    wide = docs
    for c in ("order", "idx", "share", "score", "distance", "held_out"):
        wide = wide.withColumn(c, F.lit("x"))
    assert np.array_equal(langid.train(wide).weights, plain.weights)
    assert langid.predict(wide, plain, carry=("order", "idx")).first()["order"] == "x"
