from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakecairn.llm import registry, rules
from lakecairn.llm import textkernel as K
from tests.conftest import SF
from tests.llm.helpers import DOCS, odd_docs
from tests.oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_letters": sum(c.isascii() and c.isalpha() or c > "\x7f" for c in text),
        "n_digits": sum("0" <= c <= "9" for c in text),
        "longest_word": max(map(len, w), default=0),
    }


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#|éA1", max_size=40), min_size=1, max_size=6))
def test_measurements_equal_brute_force(texts):
    for _, _, buf, off in K.slices(pa.array(texts)):
        got = rules.measure_slice(buf, off)
        for i, t in enumerate(texts):
            assert {k: int(v[i]) for k, v in got.items()} == brute(t), repr(t)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in registry.op5_quality_rules(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        b, g = brute(d.text), got[d.doc_id]
        assert all(g[k] == b[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        base = b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"]
        assert g.base_failed == base
        assert g.kept == (not base and 100 * b["n_symbols"] <= 10 * b["word_chars"] and 100 * b["n_upper"] <= 50 * b["n_letters"])


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = rules.measure(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {k: r[k] for k in rules.FIELDS} == brute(texts[r.doc_id])
    assert rules.verdicts(spark.createDataFrame([], DOCS), rules.BASE).count() == 0


def test_ledger_policies_and_ablations(spark):
    led = rules.ledger(rules.measure(spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    policy = rules.POLICIES["web", 2]
    rows = led.collect()
    kept = sum(r.failed & policy.mask == 0 for r in rows)
    assert led.filter(rules.passes(policy)).count() == kept
    for a in rules.ablations(led, policy).collect():
        assert a.n_kept == kept
        assert a.n_kept_without == sum(r.failed & policy.mask & ~a.bit == 0 for r in rows)
        assert a.n_failed == sum(r.failed & a.bit != 0 for r in rows)
        assert a.n_failed_alone == a.n_kept_without - kept
    assert rules.POLICIES["web", 1].mask == 0b10111
    assert led.filter(F.col("failed") >= 1 << len(rules.RULES)).count() == 0
    assert np.all([led.filter(r.fails).count() == led.filter(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0).count() for i, r in enumerate(rules.RULES)])


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    wide = docs
    for c in ("failed", "kept", "base_failed", "bits", "n", *rules.FIELDS):
        wide = wide.withColumn(c, F.lit("x"))
    get = lambda d: sorted(map(tuple, rules.verdicts(d, rules.POLICIES["web", 2]).collect()))
    assert get(wide) == get(docs)


def test_ablations_and_versions_equal_their_sql(spark):
    """What each rule does alone, and what each version of a policy keeps, from the ledger of all documents."""
    bits = registry.ORACLES["op5_quality_rules"].rsplit("select doc_id, n_words", 1)[0]
    names = ", ".join(f"({1 << i}::bigint, '{r.name}')" for i, r in enumerate(rules.RULES))
    sql = f"""{bits} select name as rule, bit, count(*) filter (failed & bit <> 0) as n_failed, count(*) filter (failed = bit) as n_failed_alone,
        count(*) filter (failed & ~bit = 0) as n_kept_without, count(*) filter (failed = 0) as n_kept from bits, (values {names}) r(bit, name) group by name, bit"""
    big, con = SF.replace("sf0.001", "sf0.01"), connect(SF.replace("sf0.001", "sf0.01"))
    led = rules.ledger(rules.measure(spark.read.parquet(f"{big}/documents.parquet"))).cache()
    assert same(rules.ablations(led, rules.POLICIES["web", 2]), con, sql) == len(rules.RULES)
    for policy in rules.POLICIES.values():
        assert same(led.filter(rules.passes(policy)).agg(F.count("*").alias("n")), con, f"{bits} select count(*) as n from bits where failed & {policy.mask} = 0") == 1
