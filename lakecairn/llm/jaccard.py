"""Exact Jaccard join of five-word shingle sets, size-aware.

Documents with equal sets form a class, its smallest doc_id stands for it. Then

* small sets (up to a boundary) enumerate subsets of fixed size: for each pair of
  sizes, all subsets of as many shingles as such a pair must share;
* large sets (and small ones near the boundary, for pairs across it) post the part of
  their shingles that any partner must meet, rare shingles first. Shingles that no other
  set has come first of all and need no posting, so most sets post nothing;

so that two sets which link meet under some key. Keys give chains of sets whose sizes
allow a link, chains give clusters, and within a cluster the inverted lists are scanned:
every set's overlap with every other is counted exactly. The boundary is the one of least
cost, from the numbers of sets by size.

Sets of a large cluster are mostly alike, so their lists would be scanned for what all have.
They are compared by what they differ in from a consensus, the shingles that most of some
of its sets have: the difference of two sets follows from the differences of each and what
these share, whatever the consensus is. Clusters of more than a few blocks of sets are dealt
out as pairs of blocks, as differences only.

How often each shingle occurs is counted over all sets, in sorted runs dealt out by
shingle; the most frequent ones are known to every task beforehand and skip that shuffle.

Defined cases: null text, or one without words, has an empty set, links with nothing and
is its own component; fewer than five words make one shingle; a null doc_id is never a
partner's component but takes part in its class; rows with one id are one document, linked
with whatever one of them is linked with; extra columns pass by; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K
from lakecairn.llm.graph import checkpointed, components, counted, few, forget, observed, small, unique_rows

#: Percent of the union that two sets must share.
PERCENT = 80
#: Shingles counted together for finding frequent ones, and copies among them that make one frequent.
COUNTED, FREQUENT = 1 << 19, 4
#: Most frequent shingles that are known to every task (a bound: it orders shingles, and drops none).
KNOWN = 100_000
#: Shingles, or differences, that are compared at once, about.
VOLUME = 1 << 20
#: Sets of a block, and blocks of a cluster, unless blocks were over MOST_SETS sets or half a VOLUME then.
BLOCK_SETS, BLOCKS, MOST_SETS = 64, 32, 8192
#: Sets of a cluster from which a consensus is worth its while, and sets it is taken from, about.
ALIKE, ASKED = 16, 64
#: Shingles counted at once, about, and ranges of them at most: at 100 TB a range has 16 million.
PART, MAX_PARTS = 1 << 19, 1 << 20
#: Largest size that may be a small set.
LARGEST_SMALL = 20


def must_share(a: int, b: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def partner_sizes(n: int) -> range:
    return range(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)


def n_subsets(n: int) -> int:
    return sum(comb(n, c) for m in partner_sizes(n) if (c := must_share(n, m)) <= min(n, m))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def boundary(counts: dict[int, int]) -> int:
    """The largest small size: least cost over the sets by size. A subset costs a row; a posted
    shingle a row and, as it may be frequent, one scan; a scanned set its shingles."""
    best, least = 0, None
    for b in range(LARGEST_SMALL + 1):
        edge = -(-PERCENT * (b + 1) // 100)
        cost = sum(c * ((n_subsets(n) if n <= b else 0) + (2 * prefix_length(n) + n if n >= edge else 0)) for n, c in counts.items() if n)
        if least is None or cost < least:
            best, least = b, cost
    return best


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each document."""
    for first, last, buf, off in K.slices(batch.column("text")):
        h, bound = K.shingles(buf, off)
        for i in range(last - first):
            yield first + i, np.unique(h[bound[i] : bound[i + 1]])


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(K.mix(s).sum(dtype=np.uint64).view(np.int64)), int(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


SCAN = "kind int, doc_id long, n long, k1 long, k2 long, tokens array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document's size, class key and, if it may count as small, its shingles.
    Kind 1: a shingle (k1) frequent among some documents, and its count."""
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()
    volume = 0

    def frequent() -> pa.RecordBatch:
        s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(s)))
        often = count >= FREQUENT
        held.clear()
        seen.clear()
        z = np.zeros(int(often.sum()), np.int64)
        return _rows(SCAN, z.astype(np.int32) + 1, z, count[often], s[edge[often]].view(np.int64), z, pa.nulls(len(z), pa.list_(pa.int64())))

    for batch in batches:
        size, keys, few = [], [], []
        for _, s in _sets(batch):
            key = _key(s)
            size.append(len(s))
            keys.append(key)
            few.append(s.view(np.int64) if 0 < len(s) <= LARGEST_SMALL else None)
            if len(s) and key not in seen:
                seen.add(key)
                held.append(s)
                volume += len(s)
                if volume > COUNTED:
                    yield frequent()
                    volume = 0
        if size:
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield _rows(SCAN, np.zeros(len(size), np.int32), batch.column("doc_id"), np.array(size, np.int64), k[:, 0].copy(), k[:, 1].copy(), pa.array(few, pa.list_(pa.int64())))
    yield frequent()


def _rows(schema: str, *cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def _subsets(s: np.ndarray, limit: int) -> np.ndarray:
    """The keys under which a small set meets every small set that it may link with."""
    n = len(s)
    out = [s[:0]]
    for m in partner_sizes(n):
        c = must_share(n, m)
        if c <= min(n, m) and m <= limit:
            tag = np.array([min(n, m) << 32 | max(n, m)], np.uint64)
            picks = np.array(list(combinations(range(n), c)))
            out.append(K.mix(K.mix(s[picks]).sum(1, dtype=np.uint64) + K.mix(tag)))
    return np.concatenate(out)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which the shuffle's compression makes short."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Layout:
    """How shingles are counted: bits kept of each, ranges of them, groups of documents, and the known ones."""

    bits: int
    parts: int
    known: np.ndarray  # sorted
    often: np.ndarray

    @staticmethod
    def of(total: int, known: np.ndarray, often: np.ndarray) -> Layout:
        parts = int(np.clip(total // PART, 1, MAX_PARTS))
        return Layout(int(np.clip(total.bit_length() + 12, 40, 62)), parts, known, often)

    def edges(self) -> np.ndarray:
        return np.array([(i << self.bits) // self.parts for i in range(1, self.parts)], np.int64)

    def group(self, doc: np.ndarray) -> np.ndarray:
        return (K.mix(doc.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int32)


#: Runs of counted shingles (state RUN: sorted shingles as differences), and shared ones by document (SHARED).
RUNS = "part int, state int, tokens binary, docs binary, counts binary"
RUN, SHARED, SIZES = 0, 1, 2


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Short batches: rows of packed numbers are long."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _shared(layout: Layout, doc: np.ndarray, token: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Entries (document, shingle, how often) dealt to the documents' groups."""
    group = layout.group(doc)
    order = np.lexsort((doc, group))
    doc, token, count, group = doc[order], token[order], count[order], group[order]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    cut = list(zip(begin.tolist(), np.append(begin[1:], len(group)).tolist()))
    cols = [pa.array([_planes(x[a:b]) for a, b in cut], pa.binary()) for x in (token, doc, count)]
    return _rows(RUNS, group[begin], np.full(len(cut), SHARED, np.int32), *cols)


def _count(shared):
    """Partitions of runs to entries of the shingles that two sets or more have; entries found before pass."""

    def part(layout: Layout, tokens: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        t, d = np.concatenate(tokens), np.concatenate(docs)
        order = np.argsort(t, kind="stable")
        t, d = t[order], d[order]
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(begin, len(t)))
        many = np.repeat(count > 1, count)
        return _shared(layout, d[many], t[many], np.repeat(np.minimum(count, 1 << 30), count)[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        tokens, docs, at = [], [], None
        for batch in _pieces(batches):
            state = batch.column("state").to_numpy()
            if (state == SHARED).any():
                yield batch.filter(pa.array(state == SHARED))
            runs = batch.filter(pa.array(state == RUN))
            for p, t, d in zip(*(runs.column(c).to_pylist() for c in ("part", "tokens", "docs"))):
                if p != at and tokens:
                    yield part(layout, tokens, docs)
                    tokens, docs = [], []
                at = p
                tokens.append(np.cumsum(_unplanes(t, np.int64)))
                docs.append(_unplanes(d, np.int64))
        if tokens:
            yield part(layout, tokens, docs)

    return run


SIGNED = "doc_id long, n long, tokens array<long>"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared shingles in each document's prefix, group by group."""

    def group(entries: list[tuple], sizes: list[tuple]) -> pa.RecordBatch | None:
        if not entries or not sizes:
            return None
        token, doc, count = (np.concatenate(x) for x in zip(*entries))
        ids, n = (np.concatenate(x) for x in zip(*sizes))
        ids, first = np.unique(ids, return_index=True)
        n = n[first]
        order = np.lexsort((token, count, doc))
        token, doc = token[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        have = np.diff(np.append(begin, len(doc)))
        at = np.minimum(np.searchsorted(ids, doc[begin]), len(ids) - 1)
        size = np.where(ids[at] == doc[begin], n[at], 0)
        take = np.clip(size - -(-PERCENT * size // 100) + 1 - (size - have), 0, have)
        take[size == 0] = 0
        keep = np.arange(len(doc)) - np.repeat(begin, have) < np.repeat(take, have)
        some = take > 0
        bound = np.concatenate([[0], np.cumsum(take[some])]).astype(np.int32)
        return _rows(SIGNED, doc[begin][some], size[some], pa.ListArray.from_arrays(pa.array(bound), pa.array(token[keep])))

    entries, sizes, at = [], [], None
    for batch in _pieces(batches):
        for p, state, t, d, c in zip(*(batch.column(x).to_pylist() for x in ("part", "state", "tokens", "docs", "counts"))):
            if p != at:
                if (out := group(entries, sizes)) is not None:
                    yield out
                entries, sizes, at = [], [], p
            if state == SIZES:
                sizes.append((_unplanes(d, np.int64), _unplanes(c, np.int64)))
            else:
                entries.append((_unplanes(t, np.int64), _unplanes(d, np.int64), _unplanes(c, np.int64)))
    if (out := group(entries, sizes)) is not None:
        yield out


POSTING = "key long, token long, low long, high long, doc_id long, other long"


def _chains(token: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of token and size, where each chain of sizes begins, and the chain of each row.

    A row spans the sizes low to high. Rows of a token are one chain while the next one's sizes are
    near enough to some size before.
    """
    order = np.lexsort((doc, low, token))
    token, low, high = token[order], low[order], high[order]
    fresh = np.concatenate([[True], token[1:] != token[:-1]])
    group = np.cumsum(fresh)
    top = np.maximum.accumulate((group << 40) + high) - (group << 40)
    gap = np.concatenate([[True], 100 * top[:-1] < PERCENT * low[1:]])
    begins = fresh | gap
    return order, np.flatnonzero(begins), np.cumsum(begins) - 1


def _meet(token: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """One row a chain (its token, sizes and smallest document), and edges from its documents to that."""
    order, begin, chain = _chains(token, low, high, doc)
    least = np.minimum.reduceat(doc[order], begin)
    rows = {"token": token[order][begin], "low": low[order][begin], "high": np.maximum.reduceat(high[order], begin), "doc_id": least}
    a, b = doc[order], least[chain]
    apart = a != b
    pairs = np.unique(np.stack([a[apart], b[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return rows, pairs[:, 0], pairs[:, 1]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a batch, met within it first: a frequent key leaves it as one row a chain."""
    for batch in batches:
        lists = batch.column("tokens")
        if not len(lists):
            continue
        width = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy()
        if not len(token):
            continue
        n = np.repeat(batch.column("n").to_numpy(), width)
        rows, a, b = _meet(token, n, n, np.repeat(batch.column("doc_id").to_numpy(), width))
        yield _postings(rows["token"], rows["low"], rows["high"], rows["doc_id"], None)
        if len(a):
            yield _postings(None, None, None, a, b)


def _postings(token, low, high, doc, other) -> pa.RecordBatch:
    """Postings go to their token; edges already found go anywhere."""
    none = pa.nulls(len(doc), pa.int64())
    key = token if token is not None else K.mix(doc.astype(np.uint64)).view(np.int64)
    cols = [key, none if token is None else token, none if low is None else low, none if high is None else high, doc, none if other is None else other]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in POSTING.split(", ")])


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the chains of every token; rows come in order of token and size, and the last chain goes on in the next rows."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def meet(last: bool) -> pa.RecordBatch:
        chains, a, b = _meet(*(np.concatenate(x) for x in zip(*held)))
        held[:] = [] if last else [[chains[c][-1:] for c in ("token", "low", "high", "doc_id")]]
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    for batch in batches:
        edge = batch.column("other").is_valid().to_numpy(zero_copy_only=False)
        if edge.any():
            found = batch.filter(pa.array(edge))
            yield pa.record_batch({"a": found.column("doc_id"), "b": found.column("other")})
        if not edge.all():
            rest = batch.filter(pa.array(~edge))
            held.append([rest.column(c).to_numpy() for c in ("token", "low", "high", "doc_id")])
            rows += rest.num_rows
            if rows > VOLUME:
                yield meet(False)
                rows = 0
    if held:
        yield meet(True)


def consensus(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles, sorted, that more than half of the sets have."""
    if not sets:
        return np.zeros(0, np.int64)
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    return token[2 * count > len(sets)]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What is in one of two sorted sets and not in the other."""
    return np.setxor1d(a, b, assume_unique=True)


def _compare(doc: np.ndarray, block: np.ndarray, across: bool, copies: np.ndarray, n: np.ndarray, tokens: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component (smallest doc_id) and the number of linked documents of each set, by scanning inverted lists.

    tokens: the sets themselves, of n shingles each, or their differences from some set that is the same for all.
    across: only links between different blocks are counted.
    """
    n_docs, size = len(doc), np.diff(bound)
    order = np.argsort(doc, kind="stable")
    place = np.empty(n_docs, np.int64)
    place[order] = np.arange(n_docs)  # label by doc_id, so the least label is the least doc_id
    label, links = place.copy(), np.zeros(n_docs, np.int64)
    _, ident, count = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n_docs), size)
    lists = owner[np.argsort(ident, kind="stable")]
    start = np.concatenate([[0], np.cumsum(count)])
    plain = (size == n).all()
    second = block != block.min() if n_docs else block  # of two blocks, one's sets are held against the other's
    for d in np.flatnonzero(~second) if across else range(n_docs):
        t = ident[bound[d] : bound[d + 1]]
        t = t[count[t] > 1]
        if plain and not len(t):
            continue
        width = count[t]
        total = int(width.sum())
        pick = np.arange(total) + np.repeat(start[t] - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        shared = np.bincount(lists[pick], minlength=n_docs)
        both = n + n[d]
        twice = both - size - size[d] + 2 * shared  # two times what the sets share
        near = (100 + PERCENT) * twice >= 2 * PERCENT * both
        near[d] = False
        near = np.flatnonzero(near & second if across else near)
        if len(near):
            links[d] += copies[near].sum()
            if across:
                links[near] += copies[d]
            old = np.unique(label[np.append(near, d)])
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return doc[order][label], links


LINK = "doc_id long, component long, links long"


PAIR = "part long, across boolean, doc_id long, block int, n long, copies long, tokens array<long>"


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the sets of each part; parts come one after the other and small ones are taken together."""
    held: list[pa.RecordBatch] = []
    volume = 0

    def done(rows: pa.Table, alone: bool) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lists = pa.concat_arrays(rows["tokens"].chunks)
        bound = lists.offsets.to_numpy().astype(np.int64)
        doc, n = rows["doc_id"].to_numpy(), rows["n"].to_numpy()
        tokens, bound = lists.values.to_numpy()[bound[0] : bound[-1]], bound - bound[0]
        if alone and len(doc) >= ALIKE and (np.diff(bound) == n).all():
            sets = np.split(tokens, bound[1:-1])
            most = consensus(sets)
            sets = [difference(s, most) for s in sets]
            tokens, bound = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        component, links = _compare(doc, rows["block"].to_numpy(), rows["across"][0].as_py(), rows["copies"].to_numpy(), n, tokens, bound)
        return pa.record_batch({"doc_id": pa.array(doc), "component": pa.array(component), "links": pa.array(links)})

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        for a, b in zip(edges[:-1], edges[1:]):
            piece = batch.slice(a, b - a)
            same = held and held[-1].column("part")[0].as_py() == piece.column("part")[0].as_py()
            if held and not same:
                # The last part so far may be one that must stand alone: of blocks, or with a consensus.
                first = next(i for i, x in enumerate(held) if x.column("part")[0].as_py() == held[-1].column("part")[0].as_py())
                last = held[first:]
                if last[0].column("block")[0].as_py() >= 0 or sum(x.num_rows for x in last) >= ALIKE:
                    if first:
                        yield done(pa.Table.from_batches(held[:first]), False)
                    yield done(pa.Table.from_batches(last), True)
                    held, volume = [], 0
                elif volume > VOLUME // 2:
                    yield done(pa.Table.from_batches(held), False)
                    held, volume = [], 0
            held.append(piece)
            volume += len(piece.column("tokens").flatten())
    if held:
        first = next(i for i, x in enumerate(held) if x.column("part")[0].as_py() == held[-1].column("part")[0].as_py())
        if first:
            yield done(pa.Table.from_batches(held[:first]), False)
        yield done(pa.Table.from_batches(held[first:]), True)


REFERENCE = "component long, most array<long>, share double"


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The consensus of some sets of each cluster, and the share of shingles in which they differ from it; clusters come one by one."""
    held: list[np.ndarray] = []
    at = None

    def done() -> pa.RecordBatch:
        most = consensus(held)
        share = sum(len(difference(s, most)) for s in held) / sum(len(s) for s in held)
        return pa.record_batch({"component": pa.array([at], pa.int64()), "most": pa.array([most], pa.list_(pa.int64())), "share": pa.array([share])})

    for batch in batches:
        for k, s in zip(batch.column("component").to_pylist(), batch.column("tokens")):
            if k != at and held:
                yield done()
                held.clear()
            at = k
            held.append(s.values.to_numpy())
    if held:
        yield done()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as differences from their cluster's consensus; where none was taken, that is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out = []
        for s, m in zip(batch.column("tokens"), batch.column("most")):
            s = s.values.to_numpy()
            out.append(difference(s, m.values.to_numpy()) if m.is_valid else s)
        yield pa.record_batch({c: batch.column(c) for c in ("component", "blocks", "doc_id", "n", "copies")} | {"tokens": pa.array(out, pa.list_(pa.int64()))})


def _pairs(sets: DataFrame) -> DataFrame:
    """Rows of blocks of large clusters (component, m, v: its sets and shingles, doc_id, n, copies, tokens), once a pair of blocks."""
    some = sets.filter(F.pmod(F.xxhash64(F.lit("asked"), "doc_id"), F.ceil(F.col("m") / ASKED)) == 0)
    refs = some.select("component", "tokens").repartition("component").sortWithinPartitions("component").mapInArrow(K.tidy(_references), REFERENCE)
    refs, size = observed(refs, longs=F.sum(F.size("most") + 16))
    refs = F.broadcast(refs) if (size["longs"] or 0) <= VOLUME else refs
    volume = F.col("v") * F.coalesce("share", F.lit(1.0))
    spread = F.least(F.lit(BLOCKS), F.ceil(F.col("m") / BLOCK_SETS))
    blocks = F.greatest(spread, F.ceil(F.col("m") / MOST_SETS), F.ceil(2 * volume / VOLUME)).cast("int")
    cut = sets.join(refs, "component", "left").select("component", blocks.alias("blocks"), "doc_id", "n", "copies", "tokens", "most")
    cut = cut.mapInArrow(K.tidy(_differences), "component long, blocks int, doc_id long, n long, copies long, tokens array<long>")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    cut = cut.withColumn("block", own)
    part = lambda j: F.struct(F.xxhash64("component", F.least("block", j), F.greatest("block", j)).alias("part"), (j != F.col("block")).alias("across"))
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), part)
    return cut.select(F.explode(parts).alias("p"), "doc_id", "block", "n", "copies", "tokens").select("p.part", "p.across", "doc_id", "block", "n", "copies", "tokens")


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of rows (doc_id, component, m, v, n, copies, text)."""
    for batch in batches:
        sets = [s.view(np.int64) for _, s in _sets(batch)]
        if sets:
            cols = {c: batch.column(c) for c in ("component", "m", "v", "doc_id", "n", "copies")}
            yield pa.record_batch(cols | {"tokens": pa.array(sets, pa.list_(pa.int64()))})


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents linked with it) of every row."""
    return join_rows(docs)[0]


def join_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """join(docs), and whether an id repeats."""
    keyed, repeated = unique_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if not repeated:
        return _join(keyed.select("doc_id", "text")), False
    ids = keyed.select("row", F.col("doc_id").alias("id"))
    found = _join(keyed.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    found = checkpointed(found.join(ids.filter("row is not null"), "row", "left"))
    # Rows of one id lie in one component; rows are numbered in the order of ids, so the smallest row has the smallest id.
    least = found.filter("id is not null").groupBy("id").agg(F.min("component_id").alias("b"))
    joined = components(found.join(least, "id").select(F.col("component_id").alias("a"), "b"))
    found = found.join(joined, found["component_id"] == joined["node"], "left").withColumn("component_id", F.coalesce("component", "component_id"))
    to = ids.select(F.col("row").alias("component_id"), F.col("id").alias("smallest"))
    return found.join(to, "component_id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.col("smallest").alias("component_id"), "n_links"), True


def _join(docs: DataFrame) -> DataFrame:
    """join() of documents whose ids are unique, or null."""
    spark = docs.sparkSession
    scan = checkpointed(docs.mapInArrow(K.tidy(_scan), SCAN))
    rows = scan.filter("kind = 0").select("doc_id", "n", "k1", "k2")
    few_sizes = range(1, 2 * LARGEST_SMALL + 1)
    by_size = [F.count_if((F.col("kind") == 0) & (F.col("n") == i)).alias(f"n{i}") for i in few_sizes]
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in (0, 1)]
    sizes = scan.agg(F.count_if(F.col("kind") == 0).alias("rows"), sums[0].alias("total"), sums[1].alias("often"), *by_size).first()
    limit = boundary({i: sizes[f"n{i}"] for i in few_sizes})
    least = -(-PERCENT * (limit + 1) // 100)  # smaller sets meet all their partners by subsets
    # At most KNOWN shingles can have that share of all that are counted here.
    often = scan.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("df")).filter(F.col("df") * KNOWN >= sizes["often"]).toArrow()
    known, df = often["k1"].to_numpy().view(np.uint64), often["df"].to_numpy()
    order = np.argsort(known)
    layout = spark.sparkContext.broadcast(Layout.of(sizes["total"], known[order], df[order]))

    classes = checkpointed(few(rows.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), sizes["rows"]))
    named = rows.join(classes, ["k1", "k2", "n"], "left").select("doc_id", "n", "first", "copies")
    named, n_copies = counted(few(named, sizes["rows"]), F.col("doc_id") != F.col("first"))
    copies = small(named.filter("doc_id <> first").select("doc_id"), n_copies)
    forget(spark)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted runs of the shingles of some documents, one a range; entries of known shingles."""
        lay = layout.value
        edges, parts = lay.edges(), np.arange(lay.parts, dtype=np.int32)
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc = np.repeat([i for i, _ in held], [len(s) for _, s in held]).astype(np.int64)
            s = np.concatenate([s for _, s in held])
            held.clear()
            token = (s >> np.uint64(64 - lay.bits)).view(np.int64)
            if len(lay.known):
                at = np.minimum(np.searchsorted(lay.known, s), len(lay.known) - 1)
                hit = lay.known[at] == s
                if hit.any():  # after all others in a prefix, the most frequent last
                    yield _shared(lay, doc[hit], token[hit], lay.often[at[hit]] + (1 << 30))
                token, doc = token[~hit], doc[~hit]
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            cut = np.concatenate([[0], np.searchsorted(token, edges), [len(token)]]).tolist()
            full = [(p, a, b) for p, a, b in zip(parts, cut[:-1], cut[1:]) if b > a]
            if full:
                tokens = [_planes(np.diff(token[a:b], prepend=0)) for _, a, b in full]
                docs = [_planes(doc[a:b]) for _, a, b in full]
                yield _rows(RUNS, np.array([p for p, *_ in full], np.int32), np.full(len(full), RUN, np.int32), pa.array(tokens, pa.binary()), pa.array(docs, pa.binary()), pa.nulls(len(full), pa.binary()))

        volume = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, s in _sets(batch):
                if len(s) >= least and ids[i] is not None:
                    held.append((ids[i], s))
                    volume += len(s)
                    if volume > max(COUNTED, 4 * lay.parts):
                        yield from flush()
                        volume = 0
        if held:
            yield from flush()

    def packed_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay = layout.value
        for batch in batches:
            doc, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            order = np.argsort(lay.group(doc), kind="stable")
            doc, n, group = doc[order], n[order], lay.group(doc)[order]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            cut = list(zip(begin.tolist(), np.append(begin[1:], len(group)).tolist()))
            docs, counts = (pa.array([_planes(x[a:b]) for a, b in cut], pa.binary()) for x in (doc, n))
            yield _rows(RUNS, group[begin], np.full(len(cut), SIZES, np.int32), pa.nulls(len(cut), pa.binary()), docs, counts)

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_subsets(np.array(t, np.int64).view(np.uint64), limit).view(np.int64) for t in batch.column("tokens").to_pylist()]
            yield _rows(SIGNED, batch.column("doc_id"), batch.column("n"), pa.array(keys, pa.list_(pa.int64())))

    mine = docs.filter("doc_id is not null").join(copies, "doc_id", "left_anti").select("doc_id", "text")
    shared = mine.mapInArrow(K.tidy(runs), RUNS).repartition("part").sortWithinPartitions("part").mapInArrow(K.tidy(_count(layout)), RUNS)
    measured = rows.filter(f"n >= {max(1, least)} and doc_id is not null").select("doc_id", "n").mapInArrow(K.tidy(packed_sizes), RUNS)
    large = shared.unionByName(measured).repartition("part").sortWithinPartitions("part").mapInArrow(K.tidy(lambda b: _combine(_prefixes(b))), POSTING)
    short = scan.filter(f"kind = 0 and n between 1 and {limit} and doc_id is not null").join(copies, "doc_id", "left_anti")
    posted = large.unionByName(short.select("doc_id", "n", "tokens").mapInArrow(K.tidy(lambda b: _combine(subsets(b))), POSTING))
    edges = posted.repartition("key").sortWithinPartitions("token", "low").mapInArrow(K.tidy(_reduce), "a long, b long")
    clusters = components(edges)

    reps = named.filter("doc_id = first").select(F.col("first").alias("node"), "n", "copies")
    member, n_member = counted(few(clusters.join(reps, "node").select(F.col("node").alias("doc_id"), "component", "n", "copies"), sizes["rows"]))
    volume = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("v")).filter((F.col("m") > 2 * BLOCK_SETS) | (F.col("v") > VOLUME))
    volume, n_cut = counted(few(volume, n_member))
    volume = small(volume, n_cut)
    forget(spark)

    def sets(of: DataFrame, n_rows: int) -> DataFrame:
        return docs.join(small(of, n_rows), "doc_id").select("component", "m", "v", "doc_id", "n", "copies", "text").mapInArrow(K.tidy(_full), "component long, m long, v long, doc_id long, n long, copies long, tokens array<long>")

    none = F.lit(0).cast("long")
    whole = member.join(volume, "component", "left_anti") if n_cut else member
    whole = sets(whole.select("*", none.alias("m"), none.alias("v")), n_member)
    parts = whole.select(F.xxhash64("component").alias("part"), F.lit(False).alias("across"), "doc_id", F.lit(-1).alias("block"), "n", "copies", "tokens")
    if n_cut:
        parts = parts.unionByName(_pairs(checkpointed(sets(member.join(volume, "component"), n_member))))
    links = checkpointed(parts.repartition("part").sortWithinPartitions("part", "doc_id").mapInArrow(K.tidy(_scan_lists), LINK))
    if n_cut:  # blocks of one cluster know only their own links
        joined = components(links.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))).select(F.col("node").alias("doc_id"), "component")
        links = links.groupBy("doc_id").agg(F.sum("links").alias("links")).join(joined, "doc_id", "left")
        links = checkpointed(few(links.select("doc_id", "links", F.coalesce("component", "doc_id").alias("component")), n_member))
    links = links.select(F.col("doc_id").alias("first"), "component", "links")
    out = named.join(small(links, n_member), "first", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "first", "doc_id").alias("component_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
    )
