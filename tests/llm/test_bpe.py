from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lakecairn.llm import bpe, registry
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return tokenizers.Tokenizer.from_file(PATH)


def same(lib, texts):
    tok = bpe.load(PATH)
    for text, got in zip(texts, bpe.Encoder(tok).encode(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text[:200]
        assert bpe.decode(tok, got) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    same(tokenizers.Tokenizer.from_file(PATH), texts)


def test_hard_words(lib):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeinorstlhgd'!") for _ in range(rnd.randint(1, 30))) for _ in range(20000)]
    same(lib, [" ".join(words), "a" * 3000, "!" * 3000, "aaaaaaa", "<|endoftext|>a<|startoftext|> <|endoftext", "࢐\U0001e6c0abc Σ", "x\x1cy\x85z​q "])


def test_query_equals_library(spark, lib):
    got = {r.doc_id: r for r in registry.op2_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, lib):
    docs = odd_docs(spark)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    out = bpe.encode(docs, PATH).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == lib.encode(rows[r.doc_id], add_special_tokens=False).ids
    assert bpe.digests(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    wide = docs
    for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"):
        wide = wide.withColumn(c, F.lit("x"))
    get = lambda d: sorted(tuple(map(str, r)) for r in bpe.digests(d, PATH).collect())
    assert get(wide) == get(docs)
