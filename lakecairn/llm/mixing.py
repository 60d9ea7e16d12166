"""Mixing to target weights with soft domain membership.

A classifier learnt from a labelled table gives every document its domain posteriors, from
the distinct words it has and the shares of its words' shapes.
Nonnegative rates of documents are then fitted by projected gradient descent on

    miss' * W * miss / (2 * total),    miss = expected tokens - target tokens, by domain

where a domain's expected tokens are the sum of rate * tokens * posterior over all
documents, and W is the inverse of the mean of posterior * posterior' over all tokens: with
these weights domains that are often confused do not slow the descent. Each round is one
pass that returns a few sums; a document's rate follows from its posteriors and the rounds'
gradients, so nothing is kept but those. Rounds go on until the targets are met or the miss
grows no less.

Where a document can stay once or go (``select``), the same descent projects rates to 0..1,
and a domain's target is its share of the tokens that are kept so far; the miss counts as a
part of those, so that keeping less is no way to miss less. How much stays follows from that.

Defined cases: a null or empty text has no tokens and the bias alone gives its
posteriors; without labelled rows or tokens every rate is 1; a domain that is not in the
targets has target 0, one without tokens stays without; repeated rows get equal rates;
extra columns pass by.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import quality
from lakecairn.llm import textkernel as K
from lakecairn.llm.graph import checkpointed, few

#: Labelled rows to learn from, about (documented bound).
SAMPLE = 8000
#: Value of a word that a text has; drawn rows that must have a feature for it to count.
PRESENCE, LEAST_ROWS = 0.5, 4
#: Domains at most (more are an error): posteriors and sums are vectors of this length.
MAX_DOMAINS = 1000


def sparse(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of a run of documents."""
    word, form, doc = quality.hashes(buf, off)
    has = np.unique((doc << quality.BITS) | quality.buckets(word))
    n = np.bincount(doc, minlength=len(off) - 1)
    return (
        np.concatenate([has >> quality.BITS, doc]),
        np.concatenate([has & (quality.BUCKETS - 1), quality.buckets(form)]),
        np.concatenate([np.full(len(has), PRESENCE), quality.SCALE / np.maximum(n, 1)[doc]]),
    )


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # (buckets, domains)
    bias: np.ndarray

    def posteriors(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        doc, at, value = sparse(buf, off)
        z = np.repeat(self.bias[None], n, 0)
        for d in range(len(self.domains)):
            z[:, d] += np.bincount(doc, weights=self.weights[at, d] * value, minlength=n)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, epochs: int = 5) -> Classifier:
    """Learn from about ``sample`` rows of ``labelled`` (doc_id, domain), drawn evenly by domain by a hash of the id."""
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).filter("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).filter("domain = other").drop("other")
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MAX_DOMAINS + 1).collect()}
    if len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(counts)
    empty = Classifier(domains, np.zeros((quality.BUCKETS, len(domains)), np.float32), np.zeros(len(domains)))
    if not domains:
        return empty
    each = sample / len(domains)
    rate = F.create_map(*[F.lit(x) for k in domains for x in (k, min(1.0, each / counts[k]))])
    drawn = known.filter(quality._unit() < rate[F.col("domain")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, off in K.slices(batch.column("text")):
                doc, at, value = sparse(buf, off)
                key, where = np.unique((doc << quality.BITS) | at, return_inverse=True)
                value = np.bincount(where, weights=value, minlength=len(key)).astype(np.float32)
                bound = pa.array(np.searchsorted(key >> quality.BITS, np.arange(last - first + 1)).astype(np.int32))
                cols = {c: batch.column(c).slice(first, last - first) for c in ("doc_id", "domain")}
                at = pa.array((key & (quality.BUCKETS - 1)).astype(np.int32))
                yield pa.record_batch(cols | {"idx": pa.ListArray.from_arrays(bound, at), "val": pa.ListArray.from_arrays(bound, pa.array(value))})

    table = quality.one_text(docs, drawn, "domain").mapInArrow(K.tidy(run), "doc_id long, domain string, idx array<int>, val array<float>")
    table = quality.bounded(table, "idx", F.col("doc_id")).toArrow().sort_by("doc_id").combine_chunks()
    data = [(np.asarray(i.values), np.asarray(v.values, np.float64), domains.index(y)) for i, v, y in zip(table["idx"], table["val"], table["domain"].to_pylist()) if len(i)]
    rows_with = np.bincount(np.concatenate([i for i, *_ in data]), minlength=quality.BUCKETS) if data else np.zeros(quality.BUCKETS)
    data = [(i[k], x[k], y) for i, x, y in data for k in [rows_with[i] >= LEAST_ROWS]]
    drawn_of = np.bincount([y for *_, y in data], minlength=len(domains)) if data else np.ones(len(domains))
    real = np.array([counts[d] for d in domains], float)
    # Rows weigh as their domain does in the labelled table, so that posteriors keep its shares.
    weight = (real / real.sum()) / np.maximum(drawn_of, 1) * max(1, len(data))
    w, g2 = np.zeros((quality.BUCKETS, len(domains))), np.full((quality.BUCKETS, len(domains)), 1e-6)
    bias, b2 = np.log(real / real.sum()), np.ones(len(domains))
    rng = np.random.default_rng(13)
    for _ in range(epochs):
        for j in rng.permutation(len(data)):
            i, x, y = data[j]
            z = x @ w[i] + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(4.0, weight[y])
            g = x[:, None] * p[None]
            g2[i] += g * g
            w[i] -= 0.3 * g / np.sqrt(g2[i])
            b2 += p * p
            bias -= 0.05 * p / np.sqrt(b2)
    del table
    data.clear()
    K.release()
    return Classifier(domains, w.astype(np.float32), bias)


POSTERIORS = "doc_id long, tokens long, posteriors array<double>"


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens (words) and posteriors of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n, p = [], []
            for _, _, buf, off in K.slices(batch.column("text")):
                n.append(np.diff(K.words(buf, off)[2]))
                p.append(m.posteriors(buf, off) if m.domains else np.zeros((len(off) - 1, 0)))
            if n:
                p = np.concatenate(p)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(p) + 1) * p.shape[1]).astype(np.int32)), pa.array(p.ravel()))
                yield pa.record_batch({"doc_id": batch.column("doc_id"), "tokens": pa.array(np.concatenate(n)), "posteriors": lists})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), POSTERIORS)


def _rates(p: np.ndarray, steps: np.ndarray, most: float = np.inf) -> np.ndarray:
    """The rates after these steps (one vector of domains a round), from 1, never below 0 or above most."""
    r = np.ones(len(p))
    for s in steps:
        r = np.clip(r - p @ s, 0.0, most)
    return r


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, width)


def _sum_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors v of this size: a few numbers a domain, or a pair of domains."""
    each = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    found = dict(few(each, size).collect())
    return np.array([found.get(i, 0.0) for i in range(size)])


@dataclass
class Fit:
    domains: list[str]
    targets: np.ndarray
    steps: np.ndarray
    expected: np.ndarray  # tokens by domain at the fitted rates
    natural: np.ndarray  # tokens by domain at rate 1
    most: float = np.inf  # bound of the rates

    @property
    def miss(self) -> float:
        """How far the worst domain is from its target, as a part of all tokens (with a bound: of those kept)."""
        whole = self.natural if self.most == np.inf else self.expected
        total = whole.sum() if len(whole) else 0.0
        return float(np.abs(self.expected - self.targets).max() / total) if total else 0.0


#: Rounds, and the part of the miss that they must mend, for a fit to go on.
STILL, MENDED = 12, 2e-3
#: Parts of a scaled step, and times of the plain one, that are tried in one pass.
TRIED, TIMES = (1.0, 0.5, 0.25, 0.0625), (1.0, 4.0, 16.0, 64.0)


def fit(soft: DataFrame, domains: list[str], weights: dict[str, float], tolerance: float = 1e-4, rounds: int = 200) -> Fit:
    """Projected gradient descent until every domain is within tolerance (of all tokens) of its target.

    A round tries the plain step, which never adds to the miss, longer ones, and parts of the one that is scaled by the
    documents whose rates are above 0, and takes what misses least. Targets that no nonnegative rates meet end at the least
    miss, which ``Fit.miss`` and a warning tell.
    """
    out = _descend(soft, domains, weights, tolerance, rounds)
    if out.miss > tolerance:
        total = out.natural.sum()
        warnings.warn(f"targets not met after {len(out.steps)} rounds: shares {dict(zip(domains, (out.expected / total).round(4).tolist()))} of all tokens, asked {dict(zip(domains, (out.targets / total).tolist()))}", stacklevel=2)
    return out


def select(soft: DataFrame, domains: list[str], weights: dict[str, float], tolerance: float = 1e-4, rounds: int = 60) -> Fit:
    """The same descent within 0 and 1, until every domain is within tolerance (of the kept tokens) of its share of those.

    Where no selection is found that meets them, all stay and a warning says so.
    """
    out = _descend(soft, domains, weights, tolerance, rounds, 1.0)
    if out.miss <= tolerance:
        return out
    natural = out.natural
    shares = (out.targets / out.targets.sum()).tolist()
    warnings.warn(f"no selection has the shares {dict(zip(domains, shares))}: all documents stay, with {dict(zip(domains, (natural / natural.sum()).round(4).tolist()))}", stacklevel=2)
    return Fit(domains, out.targets, out.steps[:0], natural, natural, 1.0)


def _descend(soft: DataFrame, domains: list[str], weights: dict[str, float], tolerance: float, rounds: int, most: float = np.inf) -> Fit:
    """Rounds of descent with rates within 0 and most; with a bound, targets are shares of what is kept."""
    width = len(domains)
    asked = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    bounded = most < np.inf
    shares = asked / asked.sum() if asked.sum() else asked
    base = shares if bounded else np.zeros(width)

    def sums(steps: np.ndarray, tried: np.ndarray, edge: bool = False) -> np.ndarray:
        """For each step tried: expected tokens by domain, and second moments of documents whose rates can move."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tried), width + width * width))
            for batch in batches:
                if batch.num_rows:
                    p, t = _matrix(batch.column("posteriors"), width), batch.column("tokens").to_numpy()
                    before, q = _rates(p, steps, most), p - base
                    for row, s in zip(total, tried):
                        r = np.clip(before - p @ s, 0.0, most)
                        row[:width] += (r * t) @ p
                        row[width:] += ((q * (t * ((r > 0) & (edge | (r < most))))[:, None]).T @ q).ravel()
            yield pa.record_batch({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})

        return _sum_up(soft.mapInArrow(K.tidy(run), "v array<double>"), len(tried) * (width + width * width)).reshape(len(tried), -1)

    steps = np.zeros((0, width))
    now = sums(steps, np.zeros((1, width)), edge=True)[0] if width else np.zeros(0)
    natural = now[:width]
    total = natural.sum()
    if not width or not total or not asked.sum():
        return Fit(domains, natural, steps, natural, natural, most)
    whole = lambda x: x[:width].sum() if bounded else total
    off = lambda x: x[:width] - shares * whole(x)
    m = now[width:].reshape(width, width) / total
    small = max(1e-6 * np.trace(m), 1e-12) * np.eye(width)
    w = np.linalg.inv(m + small)
    cost = lambda x: float(off(x) @ w @ off(x)) / whole(x) ** 2 if whole(x) > 1e-9 * total else np.inf
    costs = [cost(now)]
    while np.abs(off(now)).max() > tolerance * whole(now) and len(steps) < rounds:
        if len(costs) > STILL and costs[-1] > (1 - MENDED) * costs[-1 - STILL]:
            break
        miss = off(now) / total
        scaled = np.linalg.solve(now[width:].reshape(width, width) / total + small, miss)
        tried = np.concatenate([np.array(TIMES)[:, None] * (w @ miss), np.array(TRIED)[:, None] * scaled])
        tried -= (tried @ base)[:, None]  # a token kept adds to every domain's target
        got = sums(steps, tried)
        found = [cost(x) for x in got]
        best = int(np.argmin(found))
        if bounded and found[best] >= costs[-1]:
            break
        steps, now = np.concatenate([steps, tried[best][None]]), got[best]
        costs.append(found[best])
    return Fit(domains, shares * whole(now), steps, now[:width], natural, most)


def rates(soft: DataFrame, found: Fit) -> DataFrame:
    """soft with each document's fitted rate."""
    width = len(found.domains)
    if not len(found.steps):
        return soft.withColumn("rate", F.lit(1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = _rates(_matrix(batch.column("posteriors"), width), found.steps, found.most)
                yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "tokens", "posteriors")} | {"rate": pa.array(r)})

    return soft.mapInArrow(K.tidy(run), POSTERIORS + ", rate double")


def copies(rate: Column, doc_id: str = "doc_id") -> Column:
    """A whole number of copies whose mean is the rate; the same for the same document."""
    unit = F.pmod(F.xxhash64(F.lit("mix"), doc_id), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + unit).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, Fit]:
    """doc_id, tokens, posteriors, rate of every row, and the fit."""
    model = train(docs, labelled)
    soft = checkpointed(posteriors(docs, model))
    found = fit(soft, model.domains, weights)
    return rates(soft, found), found


#: Domains of the labels table, and the weights that production mixes to.
WEIGHTS = {"q1t0": 0.88, "q1t1": 0.05, "q0t0": 0.06, "q0t1": 0.01}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic labels; rows with a null label are left out."""
    return labels.filter("quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))
