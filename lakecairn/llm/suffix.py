"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a LENGTH-byte string that covers it also starts earlier in the corpus
(smaller doc_id, or the same document and an earlier start); strings never cross
documents and are judged on the input.

Every LENGTH-byte window has an anchor: its smallest Q-gram by hash, the leftmost of
equals. Equal windows have equal anchors at equal places, so

1. anchors that occur once in the corpus settle all their windows as unique;
2. the windows of each other anchor start in that Q-gram's bucket; the buckets of the most
   frequent Q-grams are told apart by the NEAR bytes before or after, which every window of
   the part has, so that a common line does not gather its documents. Buckets are refined
   by sorting windows on the bucket pointers of a later offset: pointers at depth d give
   those at depth 2d, recursively, until the whole window is compared; a window alone in
   its bucket drops out;
3. of each bucket that is left, all windows but the earliest mark their bytes.

Anchors, and equal stretches around one anchor, are met within each batch first, so a
frequent passage leaves a task as one row and not as one row a document. Most of what goes
is settled there (nine tenths of the bytes on the test tables), refinement does the rest.

Buckets come one after the other, so a task holds a bounded number of them. A bucket beyond
that is refined piece by piece; the windows that are first in their piece are then dealt out
once more, by all of their bytes, and of equal ones the earliest stays.

Defined cases: null counts as empty text; a text shorter than LENGTH loses nothing; rows
without doc_id lose nothing and remove nothing; rows that share a doc_id are ordered by
their text's hash; extra columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K
from lakecairn.llm.graph import observed, unique_rows

LENGTH, Q = 100, 32
#: Window starts whose anchors are found at once; bytes of context refined at once.
SEGMENT, REFINED = 1 << 19, 1 << 19
#: Anchors, and bytes of stretches, that a task holds at once; a larger bucket goes piece by piece.
ANCHORS_HELD, BYTES_HELD = 1 << 20, 1 << 21
#: Bytes beside a frequent anchor that tell its windows apart: half of what a window has around it.
NEAR = (LENGTH - Q) // 2
#: Occurrences in a batch that may make an anchor frequent, and frequent ones that are known to every task at most: those
#: with at least 1 / KNOWN of all such occurrences. It says how buckets are dealt out, and drops none.
FREQUENT, KNOWN = 32, 100_000
_LOW = np.uint64((1 << 20) - 1)


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window start, the anchor's hash, place, document; and the hash sums."""
    sums = K.prefix_hash(buf)
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none, none, sums
    inverse = K.powers(n + 1)[1]
    grams = K.mix((sums[q:] - sums[:-q]) * inverse[: n - q + 1] + np.uint64(q))
    wide = length - q + 1
    firsts, lasts, places = [], [], []
    valid = np.zeros(n - length + 1, bool)
    for a, b in zip(off[:-1], off[1:]):
        valid[a : max(a, b - length + 1)] = True
    for a in range(0, len(valid), SEGMENT):
        count = min(SEGMENT, len(valid) - a)
        least = grams[a : a + count + wide - 1] & ~_LOW
        least |= np.arange(len(least), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: count], least[wide - span : wide - span + count])
        place = (least[:count] & _LOW).astype(np.int64)
        at = np.flatnonzero(valid[a : a + count])
        if not len(at):
            continue
        place = place[at]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        firsts.append(at[begin] + a)
        lasts.append(at[np.append(begin[1:], len(at)) - 1] + a)
        places.append(place[begin] + a)
    if not firsts:
        return none, none, none.astype(np.uint64), none, none, sums
    first, last, place = map(np.concatenate, (firsts, lasts, places))
    return first, last, grams[place], place, np.searchsorted(off, first, "right") - 1, sums


def _i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


FOUND = "key long, gram long, doc_id long, state int"
#: States of found anchors: alone in its batch; stands for several in its batch; known as repeated.
ALONE, STANDS, REPEATED = 0, 1, 2


def _batch_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every anchor of a batch, by hash."""
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    gram, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, buf, off in K.slices(batch.column("text")):
        _, _, g, _, d, _ = anchors(buf, off)
        gram.append(g)
        doc.append(ids[first + d].astype(np.int64))
    g, d = np.concatenate(gram), np.concatenate(doc)
    order = np.argsort(g, kind="stable")
    return g[order], d[order]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (gram, n) that are frequent in a batch."""
    for batch in batches:
        g, _ = _batch_anchors(batch)
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(g)))
        often = count >= FREQUENT
        yield pa.record_batch({"gram": pa.array(_i64(g[begin[often]])), "n": pa.array(count[often])})


def _among(known: np.ndarray, g: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(g), bool)
    return known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g


def _find(shared):
    """The anchors of a batch of documents; the known ones are repeated anyway and stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, d = _batch_anchors(batch)
            rare = ~_among(shared.value, g)
            g, d = g[rare], d[rare]
            if not len(g):
                continue
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            count = np.diff(np.append(begin, len(g)))
            state = np.where(count > 1, STANDS, ALONE).astype(np.int32)
            yield _record(FOUND, _i64(g[begin]), _i64(g[begin]), d[begin], state)
            many = np.repeat(count > 1, count)
            if many.any():
                pairs = np.unique(np.stack([d[many], _i64(g[many])], 1), axis=0)
                who = np.ascontiguousarray(pairs[:, 0])
                yield _record(FOUND, _i64(K.mix(who.astype(np.uint64))), np.ascontiguousarray(pairs[:, 1]), who, np.full(len(pairs), REPEATED, np.int32))

    return run


def _record(schema: str, *cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def _repeated(held_most: int = ANCHORS_HELD):
    """(doc_id, gram) of the anchors that occur twice or more; rows come in order of gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, before = 0, None  # before: a gram of which rows were given out already

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal held, rows, before
            g, d, s = map(np.concatenate, zip(*held))
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            end = begin[-1] if not last and len(begin) > 1 else len(g)  # the last gram may go on
            count = np.diff(np.append(begin, len(g)))
            several = (count > 1) | (np.add.reduceat(s, begin) > 0)
            if before is not None:
                several[0] |= g[0] == before
            if end < len(g):
                held, before = [(g[end:], d[end:], s[end:])], None
            elif not last and not several[-1]:
                held, end, before = [(g[-1:], d[-1:], s[-1:])], len(g) - 1, None
            else:
                held, before = [], g[-1]
            rows = sum(len(x[0]) for x in held)
            hit = (np.repeat(several, count) & (s == ALONE))[:end]
            return pa.record_batch({"doc_id": pa.array(d[:end][hit]), "gram": pa.array(g[:end][hit])})

        for batch in batches:
            s = batch.column("state").to_numpy()
            known = s == REPEATED
            if known.any():
                some = batch.filter(pa.array(known))
                yield pa.record_batch({"doc_id": some.column("doc_id"), "gram": some.column("gram")})
            if not known.all():
                held.append((batch.column("gram").to_numpy()[~known], batch.column("doc_id").to_numpy()[~known], s[~known]))
                rows += len(held[-1][0])
                if rows > held_most:
                    yield settle(False)
        if held:
            yield settle(True)

    return run


STRETCH = "key long, gram long, doc_id long, start long, stop long, bytes binary"


def _merge(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals by document; those that touch become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(fresh)
    reach = np.maximum.accumulate((group << 40) + stop) - (group << 40)
    begin = fresh | np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(begin)
    return doc[at], start[at], np.maximum.reduceat(stop, at)


def _spans(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans in one array, and its bounds."""
    size = stop - start
    bound = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(bound[-1]) + np.repeat(start - bound[:-1], size)], bound


def _binary(flat: np.ndarray, bound: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer(bound.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _parts(known: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, place: np.ndarray, d: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches (from, to), bucket and document of runs of windows a to b.

    A frequent anchor's windows are cut in two: those that have NEAR bytes after the anchor, and the others,
    which have more than NEAR before it.
    """
    hot = _among(known, g)
    split = place - NEAR  # windows from here on have NEAR bytes after the anchor
    after, before = hot & (b >= split), hot & (a < split)
    m = np.uint64(0xD6E8FEB86659FD93)
    right = K.mix(g[after] * m + K.span_hash(sums, place[after] + Q, place[after] + Q + NEAR))
    left = K.mix(g[before] * m - K.span_hash(sums, place[before] - NEAR, place[before]))
    first = np.concatenate([a[~hot], np.maximum(a, split)[after], a[before]])
    last = np.concatenate([b[~hot], b[after], np.minimum(b, split - 1)[before]])
    return first, last + LENGTH, np.concatenate([g[~hot], right, left]), np.concatenate([d[~hot], d[after], d[before]])


def _stretches(shared):
    """For each repeated anchor, the stretch that its windows cover; equal stretches of a batch but the first are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            lists = batch.column("grams")
            bound = lists.offsets.to_numpy().astype(np.int64)
            width = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(bound), 0)
            values = lists.values.to_numpy().view(np.uint64) if len(lists.values) else np.zeros(0, np.uint64)
            parts, bufs = [], []
            for first, last, buf, off in K.slices(batch.column("text")):
                if not named[first:last].any():
                    continue
                doc_of = np.repeat(np.arange(last - first), width[first:last])
                mine = values[np.concatenate([np.arange(bound[i], bound[i] + width[i]) for i in range(first, last)])]
                wanted = np.sort(K.mix(mine ^ K.mix(doc_of.astype(np.uint64) + np.uint64(1))))
                a, b, g, place, d, sums = anchors(buf, off)
                hit = _among(wanted, K.mix(g ^ K.mix(d.astype(np.uint64) + np.uint64(1)))) | _among(known, g)
                hit &= named[first + d]
                if not hit.any():
                    continue
                a, b, g, d = _parts(known, a[hit], b[hit], g[hit], place[hit], d[hit], sums)
                parts.append((g, K.span_hash(sums, a, b), ids[first + d].astype(np.int64), a - off[d], b - off[d], a, np.full(len(a), len(bufs))))
                bufs.append(buf)
            if not parts:
                continue
            g, text, doc, start, stop, a, which = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((start, doc, text, g))
            same = np.concatenate([[False], (text[order][1:] == text[order][:-1]) & (g[order][1:] == g[order][:-1])])
            lead, rest = order[~same], order[same]
            if len(rest):
                d, s, e = _merge(doc[rest], start[rest], stop[rest])
                yield _record(STRETCH, _i64(K.mix(d.astype(np.uint64))), pa.nulls(len(d), pa.int64()), d, s, e, pa.nulls(len(d), pa.binary()))
            for k, buf in enumerate(bufs):
                mine = lead[which[lead] == k]
                if len(mine):
                    size = stop[mine] - start[mine]
                    yield _record(STRETCH, _i64(g[mine]), _i64(g[mine]), doc[mine], start[mine], stop[mine], _binary(*_spans(buf, a[mine], a[mine] + size)))

    return run


def _pointers(keys: np.ndarray) -> np.ndarray:
    """A bucket pointer for each key: the end of its bucket in sorted order; -1 where the bucket holds one."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(s)))
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(np.where(count > 1, begin + count - 1, -1), count)
    return out


def refine(grams: np.ndarray, q: int, at: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers at ``depth`` of the positions ``at``: equal and not -1 for positions whose next
    ``depth`` bytes are equal. grams: the initial bucket of the q-gram at every position.

    The pointers at half the depth, of these positions and of those half a depth later, are found
    together by the same refinement and then reused.
    """
    if depth <= q:
        return grams[at].view(np.int64)
    half = -(-depth // 2)
    later = at + depth - half
    place, index = np.unique(np.concatenate([at, later]), return_inverse=True)
    pointer = refine(grams, q, place, half)
    a, b = pointer[index[: len(at)]], pointer[index[len(at) :]]
    out = np.full(len(at), -1, np.int64)
    live = np.flatnonzero((a != -1) & (b != -1))
    keys = K.mix(a[live].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + K.mix(b[live].view(np.uint64)))
    out[live] = _pointers(keys)
    return out


def _settle(doc: np.ndarray, start: np.ndarray, flat: np.ndarray, bound: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Intervals of the windows of these stretches that have an equal, earlier one among them; hash, document and start of the others."""
    q = LENGTH // 4
    sums = K.prefix_hash(flat)
    n = len(flat)
    grams = np.zeros(n, np.uint64)
    grams[: n - q + 1] = K.mix((sums[q:] - sums[:-q]) * K.powers(n + 1)[1][: n - q + 1] + np.uint64(q))
    count = np.diff(bound) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    pointer = refine(grams, q, bound[row] + shift, LENGTH)
    where = start[row] + shift
    live = np.flatnonzero(pointer >= 0)
    order = live[np.lexsort((where[live], doc[row[live]], pointer[live]))]
    p = pointer[order]
    late = order[np.concatenate([[False], p[1:] == p[:-1]])] if len(p) else order
    first = np.ones(len(row), bool)
    first[late] = False
    at = bound[row[first]] + shift[first]
    return _merge(doc[row[late]], where[late], where[late] + LENGTH), (_i64(K.span_hash(sums, at, at + LENGTH)), doc[row[first]], where[first])


CUT = "doc_id long, start long, stop long, gram long, window long"


def _cut(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    return _record(CUT, doc, start, stop, none, none)


def _refine(held_most: int = BYTES_HELD):
    """Intervals to remove, from stretches in order of gram; of a bucket over held_most bytes also the first windows of its pieces."""

    def settled(table: pa.Table, open_: bool) -> Iterator[pa.RecordBatch]:
        gram, doc, start, stop = (table[c].to_numpy() for c in ("gram", "doc_id", "start", "stop"))
        text = []
        for chunk in table["bytes"].chunks:
            for _, _, buf, off in K.slices(chunk):
                text.append(K.span_hash(K.prefix_hash(buf), off[:-1], off[1:]))
        text = np.concatenate(text)
        order = np.lexsort((start, doc, text, gram))
        g, t = gram[order], text[order]
        same = np.concatenate([[False], (t[1:] == t[:-1]) & (g[1:] == g[:-1])])
        equal, lead = order[same], order[~same]
        if len(equal):
            yield _cut(*_merge(doc[equal], start[equal], stop[equal]))
        g = gram[lead]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        if not open_:  # one stretch alone has no equal windows
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(g)))
            keep = np.repeat(count > 1, count)
            lead, g, new = lead[keep], g[keep], new[keep]
        if not len(lead):
            return
        size = np.cumsum(stop[lead] - start[lead])
        part = size // REFINED
        part = part[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]  # a bucket stays whole
        for k in np.unique(part):
            mine = lead[part == k]
            column = table["bytes"].take(pa.array(mine)).combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
            bound = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            flat = np.frombuffer(column.buffers()[2], np.uint8)[bound[0] : bound[-1]]
            late, (window, d, s) = _settle(doc[mine], start[mine], flat, bound - bound[0])
            yield _cut(*late)
            if open_:
                yield _record(CUT, d, s, s + LENGTH, np.full(len(d), g[0]), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, before = 0, None  # before: a gram of which a piece was refined already
        for batch in batches:
            open_ = batch.column("bytes").is_valid().to_numpy(zero_copy_only=False)
            if not open_.all():
                rows = batch.filter(pa.array(~open_))
                yield _cut(*(rows.column(c).to_numpy() for c in ("doc_id", "start", "stop")))
            if not open_.any():
                continue
            held.append(batch.filter(pa.array(open_)))
            size += held[-1].column("bytes").nbytes
            if size <= held_most:
                continue
            table = pa.Table.from_batches(held)
            gram = table["gram"].to_numpy()
            first, last = (int(np.searchsorted(gram, gram[k], side)) for k, side in ((0, "right"), (-1, "left")))
            if before is not None and gram[0] == before:  # one more piece of that bucket
                yield from settled(table.slice(0, first), True)
                before, done = (before if first == len(gram) else None), first
            elif first == len(gram):  # a bucket that is larger than what is held
                yield from settled(table, True)
                before, done = gram[0], first
            else:
                yield from settled(table.slice(0, last), False)
                before, done = None, last
            held = table.slice(done).to_batches() if done < len(gram) else []
            size = sum(b.column("bytes").nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held)
            gram = table["gram"].to_numpy()
            if before is not None and gram[0] == before:
                first = int(np.searchsorted(gram, before, "right"))
                yield from settled(table.slice(0, first), True)
                table = table.slice(first)
            if table.num_rows:
                yield from settled(table, False)

    return run


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals as they are, and those of the windows that equal the one before them; rows come in order of window, gram, document and start."""
    w0 = g0 = None
    for batch in batches:
        open_ = batch.column("window").is_valid().to_numpy(zero_copy_only=False)
        if not open_.all():
            rows = batch.filter(pa.array(~open_))
            yield pa.record_batch({c: rows.column(c) for c in ("doc_id", "start", "stop")})
        if not open_.any():
            continue
        batch = batch.filter(pa.array(open_))
        w, g, doc, start = (batch.column(c).to_numpy() for c in ("window", "gram", "doc_id", "start"))
        late = np.concatenate([[w[0] == w0 and g[0] == g0], (w[1:] == w[:-1]) & (g[1:] == g[:-1])])
        w0, g0 = w[-1], g[-1]
        d, s, e = _merge(doc[late], start[late], start[late] + LENGTH)
        yield pa.record_batch({"doc_id": pa.array(d), "start": pa.array(s), "stop": pa.array(e)})


def cuts(docs: DataFrame, anchors_held: int = ANCHORS_HELD, bytes_held: int = BYTES_HELD) -> DataFrame:
    """doc_id and its list of intervals (start, stop) of bytes to remove; docs: doc_id (unique, or null) and text."""
    named = docs.filter("doc_id is not null")
    often, total = observed(named.mapInArrow(K.tidy(_frequent), "gram long, n long"), n=F.sum("n"))
    often = often.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") * KNOWN >= (total["n"] or 0)).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(np.sort(often["gram"].to_numpy().view(np.uint64)))
    found = named.mapInArrow(K.tidy(_find(known)), FOUND).repartition("key").sortWithinPartitions("gram")
    found = found.mapInArrow(K.tidy(_repeated(anchors_held)), "doc_id long, gram long")
    grams = found.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))
    both = docs.join(grams, "doc_id", "left").select("doc_id", "text", "grams")
    parts = both.mapInArrow(K.tidy(_stretches(known)), STRETCH).repartition("key").sortWithinPartitions("gram")
    # Intervals go anywhere, windows to their own kind. All is one query, so that the texts are dealt out once for it and for the cutting.
    order = ("window", "gram", "doc_id", "start")
    parts = parts.mapInArrow(K.tidy(_refine(bytes_held)), CUT).withColumn("key", F.coalesce("window", F.xxhash64("doc_id")))
    out = parts.repartition("key").drop("key").sortWithinPartitions(*order).mapInArrow(K.tidy(_late), "doc_id long, start long, stop long")
    return out.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, text: bool = False, carry: tuple[str, ...] = (), anchors_held: int = ANCHORS_HELD, bytes_held: int = BYTES_HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``text`` also the kept bytes, and columns to carry.

    Carried columns travel with the cuts, so that the texts are dealt out once. They are null where doc_id is.
    """
    wanted = {f"_{k}": c for k, c in enumerate(carry)}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in wanted.items()])
    named, repeated = unique_rows(docs)
    if repeated:
        named = named.withColumn("_id", F.col("doc_id"))
        wanted["_id"] = "_id"
    named = named.withColumn("doc_id", F.col("row")).drop("row")
    rows = named.select("doc_id", "text")
    side = cuts(rows, anchors_held, bytes_held)
    if wanted:
        side = named.select("doc_id", *wanted).filter("doc_id is not null").join(side, "doc_id", "left")
    types = dict(named.dtypes)
    schema = RESULT + (", kept binary" if text else "") + "".join(f", `{c}` {types[c]}" for c in wanted)
    names = [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * text + list(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("cuts")
            out, done = [], 0
            for first, last, buf, off in K.slices(batch.column("text")):
                for i in range(last - first):
                    data = buf[off[i] : off[i + 1]]
                    pieces, removed, spans = [data], 0, 0
                    if lists[first + i].is_valid and len(lists[first + i]):
                        cut = lists[first + i].values
                        start, stop = cut.field("start").to_numpy(), cut.field("stop").to_numpy()
                        _, start, stop = _merge(np.zeros(len(start), np.int64), start, stop)
                        pieces = [data[a:b] for a, b in zip(np.append(0, stop), np.append(start, len(data)))]
                        removed, spans = int((stop - start).sum()), len(start)
                    kept = b"".join(p.tobytes() for p in pieces)
                    out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if text else None))
                n, removed, spans, sha, kept = zip(*out)
                cols = [batch.column("doc_id").slice(done, len(out)), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())]
                cols += [pa.array(kept, pa.binary())] * text + [batch.column(c).slice(done, len(out)) for c in wanted]
                yield pa.record_batch(cols, names=names)
                done += len(out)
                out.clear()

    out = rows.join(side, "doc_id", "left").select("doc_id", "text", "cuts", *wanted).mapInArrow(K.tidy(run), schema)
    first = F.col("_id" if repeated else "doc_id").alias("doc_id")
    return out.select(first, *[c for c in out.columns if c != "doc_id" and c not in wanted], *[F.col(k).alias(c) for k, c in wanted.items() if k != "_id"])
