"""Rolling hash of bytes by a cyclic polynomial.

With T the byte table, H_i = xor over the last n bytes of rotl(T[b], age). One running
xor of rotr(T[b_k], k) and its value n places before give H_i by one rotation, so the work
per byte does not depend on the window. ``rolled`` and ``boundaries`` do that on whole byte
strings at once, for data of any size; ``roll_frame`` is the same as window functions, with
one row a byte, for strings that are to be looked at in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
#: Window in bytes, and bits of the boundary pattern.
WINDOW, PATTERN_BITS = 67, 12


def byte_table(seed: str = "lakecairn") -> list[int]:
    """256 32-bit values, from a digest of the seed and the byte."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{b}".encode()).digest()[:4], "big") for b in range(256)]


def roll(data: bytes, window: int = WINDOW, table: list[int] | None = None) -> list[int]:
    """The hash after each byte, one by one: what the window form must equal."""
    table = table or byte_table()
    out, h = [], 0
    turn = lambda v, k: (v << k | v >> (32 - k)) & MASK32 if k else v
    for i, b in enumerate(data):
        h = turn(h, 1)
        if i >= window:
            h ^= turn(table[data[i - window]], window % 32)
        h ^= table[b]
        out.append(h)
    return out


@lru_cache(maxsize=8)
def _turned(table: tuple[int, ...] | None) -> np.ndarray:
    """The byte table turned right by 0 to 31 bits, one after the other."""
    t = np.array(table or byte_table(), np.uint64)
    k = np.arange(32, dtype=np.uint64)[:, None]
    return (((t >> k) | (t << (np.uint64(32) - k))) & np.uint64(MASK32)).astype(np.uint32).ravel()


def hash_array(data: np.ndarray, window: int = WINDOW, table: list[int] | None = None) -> np.ndarray:
    """roll() of a byte array at once."""
    turned = _turned(tuple(table) if table else None)
    k = np.arange(len(data), dtype=np.int64) & 31
    t = turned[(k << 8) | data]
    running = np.bitwise_xor.accumulate(t) if len(t) else t
    x = running.copy()
    x[window:] ^= running[:-window]
    k = k.astype(np.uint32)
    return ((x << k) | (x >> ((np.uint32(32) - k) & np.uint32(31)))).astype(np.uint64)


def _each(df: DataFrame, key: str, data: str, rows, schema: str) -> DataFrame:
    """rows(keys, byte strings) of short runs of a frame; null gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept = [(k, np.frombuffer(b, np.uint8)) for k, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if b is not None]
                if kept:
                    yield rows(*zip(*kept))

    return df.select(F.col(key).cast("bigint").alias(key), F.col(data).cast("binary").alias("_data")).mapInArrow(run, f"`{key}` bigint, {schema}")


def rolled(df: DataFrame, key: str, data: str, window: int = WINDOW, table: list[int] | None = None) -> DataFrame:
    """key and hashes (the hash after each byte) of every byte string."""

    def rows(keys: tuple, blobs: tuple) -> pa.RecordBatch:
        hashes = [hash_array(b, window, table).astype(np.int64) for b in blobs]
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=[key, "hashes"])

    return _each(df, key, data, rows, "hashes array<bigint>")


def summary(df: DataFrame, key: str, data: str, window: int = WINDOW, table: list[int] | None = None) -> DataFrame:
    """key, and the number, greatest and xor of the hashes of every byte string that has a byte; no hash leaves the task."""

    def rows(keys: tuple, blobs: tuple) -> pa.RecordBatch:
        out = [(k, len(b), int(h.max()), int(np.bitwise_xor.reduce(h))) for k, b in zip(keys, blobs) if len(b) for h in [hash_array(b, window, table)]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=[key, "n", "top", "mixed"])

    return _each(df, key, data, rows, "n bigint, top bigint, mixed bigint")


def boundaries(df: DataFrame, key: str, data: str, bits: int = PATTERN_BITS, window: int = WINDOW, table: list[int] | None = None) -> DataFrame:
    """key, pos, h of the bytes whose hash has all the pattern's bits."""
    mask = np.uint64((1 << bits) - 1)

    def rows(keys: tuple, blobs: tuple) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        for k, b in zip(keys, blobs):
            h = hash_array(b, window, table)
            at = np.flatnonzero(h & mask == mask)
            for col, x in zip(out, (np.full(len(at), k), at, h[at].astype(np.int64))):
                col.append(x.astype(np.int64))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=[key, "pos", "h"])

    return _each(df, key, data, rows, "pos bigint, h bigint")


def roll_frame(df: DataFrame, key: str, data: str, window: int = WINDOW, table: list[int] | None = None) -> DataFrame:
    """One row a byte: key, pos, b, h. A row of ``df`` is one byte string; windows never cross them."""
    values = F.array(*[F.lit(x).cast("bigint") for x in table or byte_table()])
    each = df.select(key, F.posexplode(F.expr(f"transform(sequence(1, octet_length(`{data}`)), i -> conv(hex(substring(cast(`{data}` as binary), i, 1)), 16, 10))")).alias("pos", "b")).filter(F.octet_length(F.col("b")) > 0)
    each = each.withColumn("b", F.col("b").cast("int")).withColumn("pos", F.col("pos").cast("bigint"))
    turned = each.withColumn("t", F.element_at(values, F.col("b") + 1)).withColumn("k", (F.col("pos") % 32).cast("int"))
    turned = turned.withColumn("r", F.expr(f"((shiftright(t, k) | shiftleft(t, 32 - k)) & {MASK32})"))
    order = Window.partitionBy(key).orderBy("pos")
    running = turned.withColumn("p", F.expr("bit_xor(r)").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = running.withColumn("x", F.col("p").bitwiseXOR(F.coalesce(F.lag("p", window).over(order), F.lit(0).cast("bigint"))))
    return both.select(key, "pos", "b", F.expr(f"((shiftleft(x, k) | shiftright(x, 32 - k)) & {MASK32})").alias("h"))


def is_boundary(h: Column, bits: int = PATTERN_BITS) -> Column:
    mask = (1 << bits) - 1
    return h.bitwiseAND(F.lit(mask)) == mask
