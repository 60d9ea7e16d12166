"""Quality rules as a ledger of failure bits.

``measure`` takes every measurement of every whole text once; ``ledger`` turns them
into one bit a rule (1: the rule failed). Policies are named, versioned masks over
those bits: applying one, comparing two or removing a rule reads only the ledger.

Defined cases: a null or empty text has all measurements 0 and fails the rules that
ask for words; repeated rows give equal rows; extra columns pass by; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K

#: The symbol characters that count.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "longest_word")


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    return K.mix(hashes + K.mix(doc.astype(np.uint64) + np.uint64(1)))


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[off[1:]] - total[off[:-1]]


def measure_slice(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of a run of documents."""
    n_docs = len(off) - 1
    start, end, first = K.words(buf, off)
    n_words = np.diff(first)
    sums = K.prefix_hash(buf)
    head = (buf & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head)])
    in_word = chars[end] - chars[start]
    word_doc = np.repeat(np.arange(n_docs), n_words)

    cuts = np.zeros(len(buf) + 1, bool)
    cuts[off[:-1][np.diff(off) > 0]] = True
    cuts[1:] |= np.append(buf == 10, False)[:-1]
    line_start = np.flatnonzero(cuts[:-1]) if len(buf) else np.zeros(0, np.int64)
    line_doc = np.searchsorted(off, line_start, "right") - 1
    stop = np.append(line_start[1:], len(buf))
    line_end = np.minimum(stop, off[line_doc + 1])
    line_end = line_end - ((line_end > line_start) & (buf[np.maximum(line_end, 1) - 1] == 10))
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[filled], line_end[filled], line_doc[filled]
    key = _in_doc(K.span_hash(sums, line_start, line_end), line_doc)
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[at] = False

    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        h = K.span_hash(sums, start, end)
        m = np.uint64(0xD6E8FEB86659FD93)
        three = (h[:-2] * m + h[1:-1]) * m + h[2:]
        same = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        _, inverse, count = np.unique(_in_doc(three[same], word_doc[same]), return_inverse=True, return_counts=True)
        hit = same[count[inverse] > 1]
        for k in range(3):
            covered[hit + k] = True

    by_word = lambda x: np.bincount(word_doc, weights=x, minlength=n_docs).astype(np.int64)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, word_doc, in_word)
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    return {
        "n_words": n_words,
        "word_chars": by_word(in_word),
        "n_symbols": _sums(SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(line_doc, weights=again, minlength=n_docs).astype(np.int64),
        "n_repeat_words": by_word(covered),
        "n_lines": np.bincount(line_doc, minlength=n_docs),
        "n_upper": _sums(upper, off),
        "n_letters": _sums(upper | lower | (head & (buf >= 128)), off),
        "n_digits": _sums((buf >= 48) & (buf <= 57), off),
        "longest_word": longest,
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_slice(buf, off) for _, _, buf, off in K.slices(batch.column("text"))]
            if parts:
                cols = {f: pa.array(np.concatenate([p[f] for p in parts]).astype(np.int64)) for f in FIELDS}
                yield pa.record_batch({"doc_id": batch.column("doc_id")} | cols)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), "doc_id long, " + ", ".join(f"{f} long" for f in FIELDS))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements; whole numbers only, so every engine agrees


#: A rule's place is its bit: append, never reorder, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * n_letters"),
    Rule("few_letters", "100 * n_letters < 50 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("endless_word", "longest_word > 1000"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = {
    (p.name, p.version): p
    for p in (
        BASE,
        Policy("web", 1, ("few_words", "repeated_windows", "symbols", "shouting")),
        Policy("web", 2, tuple(r.name for r in RULES)),
    )
}


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``failed``: one bit a rule, in the order of the rules."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, fail it alone, and rows kept without it.

    The ledger is first reduced to its distinct bit patterns (2 to the number of rules at most).
    """
    mask = policy.mask
    patterns = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    held = [(i, r.name) for i, r in enumerate(rules) if mask >> i & 1]
    each = F.explode(F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(name).alias("rule")) for i, name in held]))
    per = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.bit", "r.rule")
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    bit, bits = F.col("bit"), F.col("bits")
    return per.groupBy("rule", "bit").agg(
        n_if(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        n_if(bits == bit).alias("n_failed_alone"),
        n_if((bits == 0) | (bits == bit)).alias("n_kept_without"),
        n_if(bits == 0).alias("n_kept"),
    )


def verdicts(docs: DataFrame, policy: Policy) -> DataFrame:
    """The ledger of documents with base_failed and kept under a policy."""
    led = ledger(measure(docs))
    base = ~passes(BASE)
    return led.withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))
