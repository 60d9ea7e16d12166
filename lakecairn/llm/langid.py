"""Language identification by error-correcting output codes.

Each language gets a codeword of +1/-1 bits. One binary classifier per bit (a
logistic model on hashed byte n-grams of the whole text) predicts it; decoding
sums the logistic loss of each codeword's bits and takes the nearest codeword.
A document whose two nearest codewords differ by less than ``ambiguity`` nats of
mean loss is flagged.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; no
labelled rows gives ``und`` for every row; repeated rows are predicted alike;
extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K
from lakecairn.llm.quality import bounded

#: n-gram orders, and buckets of each order's table.
ORDERS, BUCKETS = (2, 3, 4), 1 << 15
#: Rows of the training sample, shared evenly by the languages (documented bound).
SAMPLE = 3000
#: Mean loss of the nearest codeword from which a text is in none of the languages; 0.69 says nothing either way.
FAR = 0.4


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _clean(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters; other ASCII becomes a space."""
    out = K.LOWER[buf]
    after = np.zeros(len(out), bool)
    after[1:] = out[:-1] == 0xC3
    out = np.where(after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97), out + 32, out).astype(np.uint8)
    out[(out < 97) | ((out > 122) & (out < 128))] = 32
    return out


def ngram_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-grams that start at each byte, one row an order; where they may start.

    An n-gram never crosses documents and never holds two spaces in a row.
    """
    low = _clean(buf)
    n = len(low)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    out = np.zeros((len(ORDERS), n), np.int32)
    ok = np.zeros((len(ORDERS), n), bool)
    code = low.astype(np.uint64)
    acc = np.zeros(n, np.uint64)
    gap = np.zeros(n, bool)
    space = low == 32
    for k in range(max(ORDERS)):
        if k < n:
            acc[: n - k] = acc[: n - k] * np.uint64(257) + code[k:] + np.uint64(1)
            if k:
                gap[: n - k] |= space[k - 1 : n - 1] & space[k:]
        if k + 1 in ORDERS:
            row = ORDERS.index(k + 1)
            out[row] = (K.mix(acc) >> np.uint64(49)).astype(np.int32) + row * BUCKETS
            ok[row] = (left > k) & ~gap & ~(space if k == 0 else np.zeros(1, bool))
    return out, ok


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    alpha = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(alpha)])
    out = (sums[off[1:]] - sums[off[:-1]]) > 0
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int, bits: int = 31, seed: int = 1) -> np.ndarray:
    """n codewords: the exhaustive code for few languages, else the best spread of seeded ones."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns).T.astype(float)
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > best and (np.abs(code.sum(0)) < n).all():
            best, found = apart.min(), code
    return found


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # (buckets, bits)
    bias: np.ndarray

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean weight of each document's n-grams plus the bias, by bit."""
        n = len(off) - 1
        total, count = np.zeros((n, self.code.shape[1])), np.zeros(n)
        step = 1 << 17
        grams, ok = ngram_buckets(buf, off)
        doc = np.repeat(np.arange(n), np.diff(off))
        for row in range(len(ORDERS)):
            for a in range(0, len(buf), step):
                keep = np.flatnonzero(ok[row, a : a + step]) + a
                if not len(keep):
                    continue
                who = doc[keep]
                edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                total[who[edge]] += np.add.reduceat(self.weights[grams[row, keep]], edge, axis=0)
                count[who[edge]] += np.diff(np.append(edge, len(who)))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share of the likelihood, the second nearest, and the gap in mean loss."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = order[:, 0], order[:, min(1, loss.shape[1] - 1)]
        least = np.take_along_axis(loss, best[:, None], 1)
        score = 1 / np.exp(-(loss - least)).sum(1)
        gap = (np.take_along_axis(loss, second[:, None], 1) - least)[:, 0] / self.code.shape[1]
        return best, score, second, gap

    def distance(self, margins: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Mean loss of a codeword's bits."""
        return np.logaddexp(0, -margins * self.code[best]).mean(1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, buf, off in K.slices(batch.column("text")):
            grams, ok = ngram_buckets(buf, off)
            idx, share = [], []
            for d in range(last - first):
                part = np.s_[off[d] : off[d + 1]]
                u, c = np.unique(grams[:, part][ok[:, part]], return_counts=True)
                idx.append(u)
                share.append((c / max(1, c.sum())).astype(np.float32))
            yield pa.record_batch(
                {
                    "lang": batch.column("lang").slice(first, last - first),
                    "order": batch.column("order").slice(first, last - first),
                    "idx": pa.array(idx, pa.list_(pa.int32())),
                    "share": pa.array(share, pa.list_(pa.float32())),
                }
            )


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 8) -> Model:
    """Fit the bit classifiers on about ``sample`` rows (text, lang), drawn evenly by language.

    The draw goes by the text's own hash, so it is the same wherever rows lie, and a text is learnt once however often it stands there.
    """
    rows = labelled.select("text", "lang").filter("lang is not null and text is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    code = codewords(len(langs))
    dims = len(ORDERS) * BUCKETS
    weights, bias = np.zeros((dims, code.shape[1])), np.zeros(code.shape[1])
    if not langs:
        return Model([], code, weights.astype(np.float32), bias)
    each = max(1, sample // len(langs))
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / counts[k]))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    drawn = rows.withColumn("order", F.xxhash64("text")).filter(unit < rate[F.col("lang")]).dropDuplicates(["order", "lang"])
    table = drawn.mapInArrow(K.tidy(_features), "lang string, order long, idx array<int>, share array<float>")
    table = bounded(table, "idx", F.col("order")).toArrow()
    table = table.sort_by([("order", "ascending"), ("lang", "ascending")]).combine_chunks()
    data = [
        (langs.index(lang), np.asarray(i.values), np.asarray(s.values))
        for lang, i, s in zip(table["lang"].to_pylist(), table["idx"], table["share"])
        if len(i)
    ]
    grad = np.full((dims, code.shape[1]), 1e-6)
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        for j in rng.permutation(len(data)):
            y, idx, share = data[j]
            sign = code[y]
            margin = share @ weights[idx] + bias
            pull = sign / (1 + np.exp(sign * margin))
            g = share[:, None] * pull[None]
            grad[idx] += g * g
            weights[idx] += 1.0 * g / np.sqrt(grad[idx])
            bias += 0.01 / (1 + epoch) * pull
    del table
    data.clear()
    K.release()
    return Model(langs, code, weights.astype(np.float32), bias)


SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean, lang_second string, distance double"


def predict(docs: DataFrame, model: Model, ambiguity: float = 0.1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, lang_second and distance for every row's whole text, and the columns to carry."""
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            out = []
            for first, last, buf, off in K.slices(batch.column("text")):
                n = last - first
                pred, second = np.full(n, len(m.langs)), np.full(n, len(m.langs))
                score, gap, far = np.zeros(n), np.zeros(n), np.zeros(n)
                if m.langs:
                    known = has_letter(buf, off)
                    margins = m.margins(buf, off)
                    best, p, other, apart = m.decode(margins)
                    far = m.distance(margins, best)
                    pred, second = np.where(known, best, len(m.langs)), np.where(known, other, len(m.langs))
                    score, gap = np.where(known, p, 0.0), np.where(known, apart, 0.0)
                out.append((pred, score, gap < ambiguity, second, far))
            if out:
                pred, score, unsure, second, far = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "lang_pred": pa.array(names[pred], pa.string()),
                        "score": pa.array(score),
                        "ambiguous": pa.array(unsure),
                        "lang_second": pa.array(names[second], pa.string()),
                        "distance": pa.array(far),
                    }
                    | {c: batch.column(c) for c in carry}
                )

    return docs.select(F.col("doc_id").cast("long"), "text", *(c for c in carry if c != "text")).mapInArrow(K.tidy(run), SCHEMA + "".join(f", `{c}` {types[c]}" for c in carry))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, then predict every row."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out())
