from __future__ import annotations

import pytest

import corpus_pipeline
from lakecairn.llm import registry
from tests.conftest import SF
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) == 200


def test_one_query_an_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in registry.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_dedup", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.QUERIES) == {"pipeline"}
