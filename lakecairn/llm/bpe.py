"""Byte-pair encoding by speculation and verification, and its inverse.

For each distinct word of a slice of texts:

1. greedy longest match proposes tokens;
2. every adjacent pair of proposed tokens, of all words at once, is tested for
   compatibility: walking back through both tokens' merges, no merge across the
   border may come before the merges that made the tokens there;
3. only words with a pair or a token that fails are merged exactly, by rank.

A proposal whose tokens and borders all pass is what merging by rank gives.

Defined cases: a null text counts as empty (no ids, empty decoded text); texts are
taken whole, a word of any length included; repeated rows give equal results;
extra columns pass by.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.llm import textkernel as K

#: Words kept between slices.
CACHE = 120_000
#: Marks the hash of a token that ends a word.
_END = np.uint64(0xA5A5A5A5DEADBEEF)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 itself, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """What a tokenizer file of kind word BPE says, ready for use on one worker."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.path = path
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        plain = [(s.removesuffix(self.suffix), s.endswith(self.suffix), i) for s, i in self.vocab.items()] if self.suffix else [(s, False, i) for s, i in self.vocab.items()]
        spelt = [(bytes([byte_of[c] for c in s]), end, i) for s, end, i in plain if s and all(c in byte_of for c in s)]
        size = np.array([len(s) for s, *_ in spelt])
        stop = np.cumsum(size)
        flat = np.frombuffer(b"".join(s for s, *_ in spelt), np.uint8)
        key = K.span_hash(K.prefix_hash(flat), stop - size, stop) ^ np.array([_END if end else 0 for _, end, _ in spelt], np.uint64)
        self.tokens = K.HashIndex(key, np.array([i for *_, i in spelt]))
        #: Longest token that starts with two given bytes.
        self.reach = np.ones(1 << 16, np.int64)
        np.maximum.at(self.reach, flat[stop - size] * np.int64(256) + np.append(flat, 0)[np.where(size > 1, stop - size + 1, len(flat))], size)

        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        n = max(self.vocab.values()) + 1
        left, right = (np.array([self.vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.n = n
        self.rank = np.full(n, -1, np.int64)
        self.rank[made] = np.arange(len(merges))
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.left[made], self.right[made] = left, right
        pair = left * n + right
        self.pairs = K.HashIndex(K.mix(pair.astype(np.uint64)), np.arange(len(merges)))
        self.made = made
        self.merge = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made))}
        whole = made[~self.crossed(left, right, self.rank[made], self.rank[made])]
        sound = np.zeros(n, bool)
        sound[self.rank < 0] = True
        kept = np.zeros(n, bool)
        kept[whole] = True
        for r in np.argsort(self.rank[made], kind="stable"):  # parts come before the whole
            z = made[r]
            sound[z] = kept[z] and sound[left[r]] and sound[right[r]]
        self.sound = sound
        #: Ids of single bytes, inside a word and at its end.
        self.single = [np.array([self.vocab[c + tail] for c in self.letters], np.int64) for tail in ("", self.suffix)]

    def crossed(self, x: np.ndarray, y: np.ndarray, x_until: np.ndarray | int, y_until: np.ndarray | int) -> np.ndarray:
        """Whether merging by rank would join something across the border of x and y first.

        x_until, y_until: rank of the merge that ends the token at the border (none: very large). Of two
        equal merges the left one comes first, so a merge across loses a tie to its left and wins one to its right.
        """
        never = np.int64(1 << 40)
        x, y = x.copy(), y.copy()
        until_x = np.broadcast_to(np.int64(x_until), x.shape).copy()
        until_y = np.broadcast_to(np.int64(y_until), y.shape).copy()
        out = np.zeros(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            r = self.pair_rank(a, b)
            r[r < 0] = never
            hit = (r < until_x[live]) & (r <= until_y[live]) & (r < never)
            out[live[hit]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~hit & ((ra >= 0) | (rb >= 0))
            live, ra, rb = live[go], ra[go], rb[go]
            down_y = rb >= ra  # the later merge is undone first
            i, j = live[down_y], live[~down_y]
            until_y[i] = self.rank[y[i]]
            y[i] = self.left[y[i]]
            until_x[j] = self.rank[x[j]]
            x[j] = self.right[x[j]]
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.get(K.mix((a * self.n + b).astype(np.uint64)))

    def propose(self, buf: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over words that end at ``end``: token ids, and where they start."""
        n = len(buf)
        start = np.concatenate([[0], end[:-1]])
        left = np.repeat(end, end - start) - np.arange(n)
        sums = K.prefix_hash(buf)
        reach = self.reach[buf * np.int64(256) + np.append(buf[1:], 0)]
        reach[left == 1] = 1
        reach = np.minimum(reach, left)
        best, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.arange(n)
        for k in range(1, int(reach.max(initial=0)) + 1):
            at = at[reach[at] >= k]
            key = K.span_hash(sums, at, at + k) ^ np.where(left[at] == k, _END, np.uint64(0))
            found = self.tokens.get(key)
            hit = found >= 0
            best[at[hit]], size[at[hit]] = found[hit], k
        used = np.zeros(n, bool)
        at = start[end > start]
        stop = end[end > start]
        while len(at):
            used[at] = True
            at = at + size[at]
            go = at < stop
            at, stop = at[go], stop[go]
        where = np.flatnonzero(used)
        return best[where], where

    def exact_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Merge every word by rank, one merge a word in each round."""
        size = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), size)
        ids = self.single[0][np.frombuffer(b"".join(words), np.uint8)]
        last = np.cumsum(size) - 1
        ids[last] = self.single[1][np.frombuffer(b"".join(words), np.uint8)[last]]
        none = np.int64(1) << 40
        done_ids, done_owner = [], []
        while len(ids):
            r = np.full(len(ids), none)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            found = self.pair_rank(ids[inner], ids[inner + 1])
            r[inner] = np.where(found >= 0, found, none)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat((r << 21) | np.arange(len(ids)), first)
            over = (least >> 21) == none
            width = np.diff(np.append(first, len(ids)))
            ended = np.repeat(over, width)
            done_ids.append(ids[ended])
            done_owner.append(owner[ended])
            at = (least & ((1 << 21) - 1))[~over]
            ids[at] = self.made[r[at]]
            keep = ~ended
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.split(ids[order], np.searchsorted(owner[order], np.arange(1, len(words))))

    def exact(self, letters: str) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals, in O(n log n)."""
        body = len(letters) - len(self.suffix)
        ids = [self.vocab[c] for c in letters[: body - 1]] + [self.vocab[letters[body - 1 :]]]
        n = len(ids)
        nxt, prev, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.merge[a, b][1]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [t for t, ok in zip(ids, alive) if ok]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids of each (non-empty) word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        spelt = [w.encode() for w in words]
        end = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)))
        flat, where = self.propose(np.frombuffer(b"".join(spelt), np.uint8), end)
        owner = np.searchsorted(end, where, "right")
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        inner = inner[~bad[owner[inner]]]
        never = 1 << 40
        bad[owner[inner[self.crossed(flat[inner], flat[inner + 1], never, never)]]] = True
        edge = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        raw = flat.astype("<u4").tobytes()
        out = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        redo = np.flatnonzero(bad).tolist()
        short = [i for i in redo if len(spelt[i]) <= 64]
        for i in redo:
            if len(spelt[i]) > 64:
                out[i] = np.array(self.exact("".join([self.letters[b] for b in spelt[i]]) + self.suffix), "<u4").tobytes()
        for k in range(0, len(short), 10000):
            part = short[k : k + 10000]
            for i, ids in zip(part, self.exact_all([spelt[i] for i in part])):
                out[i] = ids.astype("<u4").tobytes()
        return out

    def split(self, text: str) -> list[str]:
        """Words and special strings of a text, in order."""
        if self.cut is None:
            return self._split(text)
        out: list[str] = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if not text.isascii():
            if max(text) > "՗" and any(unicodedata.category(c) == "Cn" for c in set(text) if c > "՗"):
                return self._split_unassigned(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words(text.lower())

    def _split_unassigned(self, text: str) -> list[str]:
        """Letters newer than this Python's tables: the library's own tables decide."""
        lib = _library(self.path)
        text = lib.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=2)
def _library(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


class Encoder:
    """Remembers words between slices, within CACHE."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self._reset()

    def _reset(self) -> None:
        tok = self.tok
        self.known = {s: np.array([i], "<u4").tobytes() for s, i in tok.special.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.tok.split(x) for x in texts]
        if len(self.known) > CACHE:
            self._reset()
        known = self.known
        new = [w for w in set().union(*parts) if w not in known]
        known.update(zip(new, self.tok.encode_words(new)))
        return [b"".join([known[w] for w in p]) for p in parts]


def decode(tok: Tokenizer, ids: bytes) -> str:
    """The tokens' strings, joined by one space (the file names no decoder)."""
    return " ".join(map(tok.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _texts(col: pa.Array) -> Iterator[list[str]]:
    for first, last, _, _ in K.slices(col):
        yield [x or "" for x in col.slice(first, last - first).to_pylist()]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load(path))
        for batch in batches:
            at = 0
            for texts in _texts(batch.column("text")):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in enc.encode(texts)]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(at, len(texts)), "ids": pa.array(ids, pa.list_(pa.int32()))})
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(K.tidy(run), "doc_id long, ids array<int>")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids, and give digests of both; with ``ids`` also the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        enc = Encoder(tok)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            at = 0
            for texts in _texts(batch.column("text")):
                found = enc.encode(texts)
                n = np.array([len(x) // 4 for x in found], np.int64)
                cols = {"doc_id": batch.column("doc_id").slice(at, len(texts)), "n_tokens": pa.array(n)}
                cols |= {"ids_sha256": pa.array([sha(x) for x in found]), "decoded_sha256": pa.array([sha(decode(tok, x).encode()) for x in found])}
                if ids:
                    bound = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(bound), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                at += len(texts)
                yield pa.record_batch(cols)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), DIGEST + (", ids array<int>" if ids else ""))
