from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from lakecairn.llm import mixing
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs
from tests.llm.test_jaccard import brute as near
from tests.llm.test_suffix import brute as repeats


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(rows) == len(after) and set(after) <= set(before) and rows
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language_id":
            assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
        elif name == "ngram_jaccard_join":
            groups = near([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c, _) in groups.items() if i == c} and len(after) < len(before)
        elif name == "suffix_dedup":
            want = repeats([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (n, gone, *_) in want.items() if not gone or gone < n}
            for i, r in after.items():
                assert r.n_chars == len(r.text) and len(r.text.encode()) <= want[i][0] - want[i][1]
                if not want[i][1]:
                    assert r.text == before[i].text
            assert any(want[i][1] for i in after)
        elif name == "mixing":
            assert all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                ids = lib.encode(before[i].text, add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids)
                assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    for docs in (odd_docs(spark), spark.createDataFrame([], DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert docs.filter("doc_id in (1, 2, 3, 9)").count() == 0


def test_mixing_meets_the_weights_by_selection(spark):
    big = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    known = mixing.label_domains(spark.read.parquet(f"{big}/labels.parquet"))
    soft = mixing.posteriors(docs, model := mixing.train(docs, known)).cache()
    goal = np.array([mixing.WEIGHTS[d] for d in model.domains])

    def off(ids, rate):
        """How far each domain's tokens are from its share of the kept ones, in deviations of the draw."""
        rows = [(r.tokens, np.array(r.posteriors), r.doc_id) for r in soft.collect()]
        miss = sum(t * (p - goal) for t, p, i in rows if i in ids)
        return miss / np.sqrt(sum((t * (p - goal)) ** 2 * rate[i] * (1 - rate[i]) for t, p, i in rows))

    kept = {r.doc_id for r in corpus_pipeline.mixing_to_weights(spark, docs, big).collect()}
    chosen = mixing.select(soft, model.domains, mixing.WEIGHTS)
    rate = {r.doc_id: r.rate for r in mixing.rates(soft, chosen).collect()}
    assert np.abs(off(kept, rate)).max() < 4 and 500 < len(kept) < 1000
    assert np.abs(chosen.expected / chosen.expected.sum() - goal).max() < 1e-3
    # One that must grow from a few hundredths to a quarter, which no rate above 1 may bring about.
    weights = dict(zip(model.domains, [0.25] * 4))
    found = mixing.select(soft, model.domains, weights)
    rated = {r.doc_id: r for r in mixing.rates(soft, found).collect()}
    assert all(0 <= r.rate <= 1 for r in rated.values())
    total = sum(r.rate * r.tokens * np.array(r.posteriors) for r in rated.values())
    assert np.allclose(total, found.expected) and np.allclose(total / total.sum(), 0.25, atol=1e-3)


def test_language_stage_decides_by_row_and_by_codewords(spark):
    big = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    clean = docs.filter("text rlike '\\\\p{L}'")
    letters = np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 300)
    first = clean.first()
    more = [(-1, "asdf jkl; qwer uiop zxcv " * 20, None, "s", 0), (-2, "".join(letters), None, "s", 0), (first.doc_id, None, None, "s", 0)]
    out = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), big).collect()
    assert sorted(out) == sorted(clean.collect())
