from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecairn.llm import mixing, registry
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs

BIG = SF.replace("sf0.001", "sf0.01")


def test_totals_match_targets(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    out, fit = mixing.mix(docs, mixing.label_domains(labels), mixing.WEIGHTS)
    rows = out.toPandas()
    p = np.stack(rows.posteriors)
    assert np.allclose(p.sum(1), 1) and (rows.rate >= 0).all() and len(rows) == 1000
    expected = (rows.rate.to_numpy() * rows.tokens.to_numpy()) @ p
    assert np.allclose(expected, fit.expected)
    goal = np.array([mixing.WEIGHTS[d] for d in fit.domains]) * rows.tokens.sum()
    assert np.abs(expected - goal).max() <= 1e-3 * rows.tokens.sum()


def test_classifier_finds_domains(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    known = mixing.label_domains(labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = mixing.train(docs, known.filter(~held))
    rows = mixing.posteriors(docs, model).join(known.filter(held), "doc_id").toPandas()
    best = np.array(model.domains)[np.stack(rows.posteriors).argmax(1)]
    assert (best == rows.domain).mean() > 0.8


def test_rates_equal_a_plain_solver():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    steps = rng.normal(size=(4, 3))
    want = []
    for x in p:
        r = 1.0
        for s in steps:
            r = max(0.0, r - float(x @ s))
        want.append(r)
    assert np.allclose(mixing._rates(p, steps), want)


def test_odd_rows_and_no_labels(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(6, 1, 0), (8, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in mixing.mix(docs, mixing.label_domains(labels), mixing.WEIGHTS)[0].collect()}
    assert len(rows) == 11 and rows[1].tokens == rows[3].tokens == 0 and rows[6].rate == rows[7].rate
    out, _ = mixing.mix(docs, mixing.label_domains(labels.filter("false")), mixing.WEIGHTS)
    assert {r.rate for r in out.collect()} == {1.0}
    assert mixing.mix(spark.createDataFrame([], DOCS), mixing.label_domains(labels), mixing.WEIGHTS)[0].count() == 0


def test_copies_have_the_rate_as_mean(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(1.3).alias("rate")).select(mixing.copies(F.col("rate")).alias("n"))
    assert abs(rows.agg(F.avg("n")).first()[0] - 1.3) < 0.02
    out = registry.op8_mixing(spark, SF)
    assert out.count() == 200 and out.filter("rate < 0 or copies < floor(rate) or copies > rate + 1").count() == 0


def _least(p, t, weights, rounds=20000):
    """The least miss that nonnegative rates reach, by plain projected gradient descent with short steps."""
    total = t.sum()
    goal = weights / weights.sum() * total
    m = (p * t[:, None]).T @ p / total
    w = np.linalg.inv(m + 1e-6 * np.trace(m) * np.eye(p.shape[1]))
    r = np.ones(len(p))
    for _ in range(rounds):
        r = np.maximum(0.0, r - p @ (w @ ((r * t) @ p - goal) / total))
    return (r * t) @ p, goal, w


@pytest.mark.parametrize(
    "weights, met",
    [
        ((0.88, 0.05, 0.06, 0.01), True),
        ((0.02, 0.02, 0.02, 0.94), True),  # a domain of one hundredth is to be nearly all
        ((0.6, 0.1, 0.2, 0.1), True),
        ((0.25, 0.25, 0.25, 0.25), False),  # no document has that little of the first
        ((0.0, 0.0, 0.0, 1.0), False),  # every document has some of the others
        ((0.5, 0.0, 0.5, 0.0), False),
    ],
)
def test_hard_zero_and_infeasible_targets(spark, weights, met):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([8.0, 0.8, 1.0, 0.15], 400)
    p[:12] = rng.dirichlet([0.2, 0.2, 0.2, 9.0], 12)  # some of the rarest domain; none of them purely
    p = np.maximum(p, 1e-3)
    p /= p.sum(1, keepdims=True)
    t = rng.integers(1, 300, 400)
    soft = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p))], mixing.POSTERIORS).coalesce(2).cache()
    names = ["a", "b", "c", "d"]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = mixing.fit(soft, names, dict(zip(names, weights)))
    assert (found.miss <= 1e-4) == met == (not any("targets not met" in str(x.message) for x in said))
    if not met:
        best, goal, w = _least(p, t.astype(float), np.array(weights))
        cost = lambda x: float((x - goal) @ w @ (x - goal))
        assert 0 < cost(found.expected) <= 1.05 * cost(best)
    rates = np.array([r.rate for r in mixing.rates(soft, found).orderBy("doc_id").collect()])
    assert (rates >= 0).all() and np.allclose((rates * t) @ p, found.expected)


@pytest.mark.parametrize("weights", [(0.88, 0.05, 0.06, 0.01), (0.5, 0.2, 0.2, 0.1), (0.7, 0.06, 0.22, 0.02)])
def test_selection_is_the_descent_within_a_box(spark, weights):
    """Every step is one of the descent's, replayed by plain loops; rates stay within 0 and 1 and no round misses by more."""
    rng = np.random.default_rng(7)
    p = rng.dirichlet([4.0, 0.5, 0.8, 0.2], 400)
    t = rng.integers(1, 300, 400)
    soft = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p))], mixing.POSTERIORS).coalesce(2).cache()
    names, shares = ["a", "b", "c", "d"], np.array(weights) / sum(weights)
    found = mixing.select(soft, names, dict(zip(names, weights)))
    q, total = p - shares, t.sum()
    moments = lambda x: (q * (t * x)[:, None]).T @ q / total
    small = 1e-6 * np.trace(moments(1.0)) * np.eye(4)
    w = np.linalg.inv(moments(1.0) + small)
    r, free, before = np.ones(400), np.ones(400), np.inf
    assert len(found.steps)
    for s in found.steps:
        miss = (r * t) @ q / total
        cost = float(miss @ w @ miss) / (r @ t) ** 2
        assert cost < before
        gradient, scaled = w @ miss, np.linalg.solve(moments(free) + small, miss)
        tried = [a * gradient for a in mixing.TIMES] + [a * scaled for a in mixing.TRIED]
        assert any(np.allclose(q @ x, p @ s, rtol=1e-6, atol=1e-9) for x in tried)
        r = np.array([min(1.0, max(0.0, x - float(y @ s))) for x, y in zip(r, p)])
        free, before = ((r > 0) & (r < 1)).astype(float), cost
    kept = (r * t) @ p
    assert np.allclose([x.rate for x in mixing.rates(soft, found).orderBy("doc_id").collect()], r) and np.allclose(kept, found.expected)
    assert np.abs(kept / kept.sum() - shares).max() <= 1e-4 and found.miss <= 1e-4
    # One domain alone has no share to miss.
    assert not len(mixing.select(soft.withColumn("posteriors", F.array(F.lit(1.0))), ["a"], {"a": 1.0}).steps)


def test_a_classifier_by_plain_loops(spark):
    """Posteriors of a model are the softmax of bias and summed weights, word by word."""
    rng = np.random.default_rng(3)
    model = mixing.Classifier(["a", "b"], rng.normal(size=(mixing.quality.BUCKETS, 2)).astype(np.float32), np.array([0.3, -0.2]))
    for text in ("one two Two TWO three3", "", "a", "é É x-1 " * 5):
        buf = np.frombuffer(text.encode(), np.uint8)
        word, form, _ = mixing.quality.hashes(buf, np.array([0, len(buf)]))
        z = model.bias.copy()
        for b in {int(x) for x in mixing.quality.buckets(word)}:
            z += model.weights[b] * mixing.PRESENCE
        for b in mixing.quality.buckets(form).tolist():
            z += model.weights[b] * (mixing.quality.SCALE / len(form))
        want = np.exp(z) / np.exp(z).sum()
        assert np.allclose(model.posteriors(buf, np.array([0, len(buf)]))[0], want)


def test_clashing_columns_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs
    for c in ("row", "rate", "tokens", "posteriors", "domain", "other", "idx", "val", "v", "i"):
        wide = wide.withColumn(c, F.lit("x"))
    get = lambda d: sorted((r.doc_id, r.tokens, round(r.rate, 6)) for r in mixing.mix(d, mixing.label_domains(labels.withColumn("y", F.lit(1))), mixing.WEIGHTS)[0].collect())
    assert get(wide) == get(docs)
    twice = docs.unionByName(docs)
    assert len(get(twice)) == 2 * docs.count()


def test_targets_out_of_reach_are_reported(spark):
    soft = spark.createDataFrame([(1, 10, [0.6, 0.4]), (2, 30, [0.5, 0.5])], mixing.POSTERIORS)
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.fit(soft, ["a", "b"], {"a": 1.0}, rounds=5)


def test_too_many_domains_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 2)
    labelled = spark.createDataFrame([(6, "a"), (8, "b"), (9, "c")], "doc_id long, domain string")
    with pytest.raises(ValueError, match="more than 2 domains"):
        mixing.train(odd_docs(spark), labelled)
