"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a whole text: each word, each pair of neighbouring words, each word's
shape (runs of character classes), each pair of shapes, and whether a word repeats
the one before. They are hashed into BUCKETS; a text's value for a bucket is its
share of the text's features, scaled by SCALE. Weights come from
follow-the-regularised-leader updates, and a score is one sparse dot product.

Defined cases: a null text or one without words has no features, so the bias alone
scores it; no labelled rows gives 0.5 everywhere; equal texts score alike; doubtful
labels (null, or two of one id) are not learnt; of rows that share a labelled id one is;
extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K
from lakecairn.llm.graph import observed

BITS = 18
BUCKETS = 1 << BITS
SCALE = 8.0
#: Labelled rows to learn from, about (documented bound).
SAMPLE = 12000
#: Features (of eight bytes) that the sample has at most, about; long texts make it smaller (documented bound).
FEATURES = 6_000_000

#: Character classes of shapes: letters by case, digits, other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48


def hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, in lower case, of its shape, and the document of each."""
    start, end, first = K.words(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    low = K.LOWER[buf]
    word = K.span_hash(K.prefix_hash(low), start, end)
    shape = _SHAPE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    form = K.span_hash(K.prefix_hash(shape[keep], 1), at[start], at[end])
    return word, form + np.uint64(2), doc


def buckets(h: np.ndarray) -> np.ndarray:
    return (K.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a run of documents, and the document of each; in document order by kind."""
    word, form, doc = hashes(buf, off)
    if not len(word):
        return np.zeros(0, np.int64), doc
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    m = np.uint64(0xD6E8FEB86659FD93)
    two = lambda h, k: h[pair] * m + h[pair + 1] + np.uint64(k)
    again = (word[pair] == word[pair + 1]).astype(np.uint64) + np.uint64(77)
    kinds = [(word, doc), (form, doc), (two(word, 3), doc[pair]), (two(form - np.uint64(2), 4), doc[pair]), (again, doc[pair])]
    return np.concatenate([buckets(x) for x, _ in kinds]), np.concatenate([d for _, d in kinds])


def sparse(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each document."""
    h, doc = features(buf, off)
    key, count = np.unique((doc << BITS) | h, return_counts=True)
    owner = key >> BITS
    edge = np.searchsorted(owner, np.arange(len(off)))
    total = np.bincount(doc, minlength=len(off) - 1)
    return [((key[a:b] & (BUCKETS - 1)).astype(np.int32), (count[a:b] * (SCALE / max(1, t))).astype(np.float32)) for a, b, t in zip(edge[:-1], edge[1:], total)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        h, doc = features(buf, off)
        dot = np.bincount(doc, weights=self.weights[h], minlength=n) if len(h) else np.zeros(n)
        total = np.maximum(np.bincount(doc, minlength=n), 1) if len(h) else np.ones(n)
        return 1 / (1 + np.exp(-(dot * SCALE / total + self.bias)))


def ftrl(data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.005, l2: float = 0.02) -> Model:
    """Per-coordinate FTRL-proximal over (buckets, values, label); classes weigh the same in all."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias, bias_n = 0.0, 1.0
    labels = np.array([y for *_, y in data])
    weight = {y: len(labels) / (2.0 * max(1, (labels == y).sum())) for y in (0, 1)}
    rng = np.random.default_rng(11)

    def value(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            i, x, y = data[j]
            w = value(i)
            p = 1 / (1 + np.exp(-(x @ w + bias)))
            miss = (p - y) * weight[y]
            g = miss * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias_n += miss * miss
            bias -= 0.05 * miss / np.sqrt(bias_n)
    return Model(value(np.arange(BUCKETS)), float(bias))


def _unit() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0


def one_text(docs: DataFrame, drawn: DataFrame, label: str) -> DataFrame:
    """doc_id, label and text of the drawn ids (doc_id, label); of an id's texts the one with the smallest hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select("doc_id", label, "text")


def bounded(table: DataFrame, features: str, row: Column) -> DataFrame:
    """Rows of a sample with features (a list), fewer by a hash of the row where they have over FEATURES in all; kept in the shared folder."""
    table, seen = observed(table, n=F.sum(F.size(features)))
    part = FEATURES / max(1, seen["n"] or 0)
    return table if part >= 1 else table.filter(F.pmod(F.xxhash64(F.lit("bounded"), row), F.lit(1_000_003)) < part * 1_000_003)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` labelled rows, drawn by a hash of their ids, evenly by class where rows allow.

    The drawn labels are bounded, so they alone are sent to the scans of documents; texts are bounded by their features.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("y0")).filter("y = y0").drop("y0")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Model(np.zeros(BUCKETS), 0.0)
    rate = F.lit(0.0)
    for y, c in counts.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, sample / 2 / c))).otherwise(rate)
    drawn = known.filter(_unit() < rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, off in K.slices(batch.column("text")):
                rows = sparse(buf, off)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(first, last - first),
                        "y": batch.column("y").slice(first, last - first),
                        "idx": pa.array([i for i, _ in rows], pa.list_(pa.int32())),
                        "val": pa.array([v for _, v in rows], pa.list_(pa.float32())),
                    }
                )

    table = one_text(docs, drawn, "y").mapInArrow(K.tidy(run), "doc_id long, y int, idx array<int>, val array<float>")
    table = bounded(table, "idx", F.col("doc_id")).toArrow().sort_by("doc_id").combine_chunks()
    data = [(np.asarray(i.values), np.asarray(v.values, np.float64), y) for i, v, y in zip(table["idx"], table["val"], table["y"].to_pylist()) if len(i)]
    del table
    model = ftrl(data) if data else Model(np.zeros(BUCKETS), 0.0)
    data.clear()
    K.release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.score(buf, off) for _, _, buf, off in K.slices(batch.column("text"))]
            if parts:
                p = np.concatenate(parts)
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), "doc_id long, score double, predicted int")
