"""Content-defined chunks of byte strings, their store, and reassembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.functions.rolling import byte_table, hash_array

#: Least, mean and greatest chunk, in bytes.
MIN_SIZE, MEAN_SIZE, MAX_SIZE = 16 << 10, 32 << 10, 64 << 10
#: Bytes that decide whether a chunk may end: shorter than any least size in use.
LOOK_BACK = 32


def _marks(data: np.ndarray, bits: int) -> np.ndarray:
    """Whether a chunk may end after each byte, by the rolling hash of the last bytes."""
    low = np.uint64(0xFFFFFFFF)
    h = hash_array(data, LOOK_BACK, byte_table("chunk"))
    # Bits are taken from a product: neighbouring positions share most bits of h itself.
    return ((h * np.uint64(0x9E3779B1)) & low) >> np.uint64(32 - bits) == 0


def cut_points(data: bytes, least: int = MIN_SIZE, mean: int = MEAN_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks. A mark is taken once a chunk has its least size, a looser one past the mean."""
    raw = np.frombuffer(data, np.uint8)
    bits = max(1, (mean - least).bit_length() - 1)
    strict, loose = np.flatnonzero(_marks(raw, bits + 1)) + 1, np.flatnonzero(_marks(raw, max(1, bits - 1))) + 1
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        i = np.searchsorted(strict, at + least)
        if i < len(strict) and strict[i] <= min(at + mean, end):
            end = int(strict[i])
        else:
            j = np.searchsorted(loose, at + mean)
            if j < len(loose) and loose[j] < end:
                end = int(loose[j])
        out.append(end)
        at = end
    return out


CHUNK = "key bigint, pos int, start bigint, size int, cid string, bytes binary"


def chunks(df: DataFrame, key: str, data: str, least: int = MIN_SIZE, mean: int = MEAN_SIZE, most: int = MAX_SIZE) -> DataFrame:
    """One row a chunk of every byte string; an empty one has a single empty chunk, null none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNK.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(k, 256)
                for ident, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = 0
                    for pos, end in enumerate(cut_points(blob, least, mean, most) or [0] if blob is not None else []):
                        piece = blob[start:end]
                        rows.append((ident, pos, start, len(piece), hashlib.sha256(piece).hexdigest(), piece))
                        start = end
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(run, CHUNK)


def index(chunked: DataFrame) -> DataFrame:
    """What names a byte string: its chunks' ids in order."""
    return chunked.select("key", "pos", "start", "size", "cid")


def blobs(chunked: DataFrame) -> DataFrame:
    """Each chunk's bytes once."""
    return chunked.groupBy("cid").agg(F.first("bytes").alias("bytes"))


def assemble(indexed: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, bytes) from an index and a store of chunks; each byte string is one row, so at most 2 GB."""
    parts = indexed.join(stored, "cid").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "bytes"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            for k in range(batch.num_rows):
                whole = b"".join(lists[k].values.to_pylist())
                yield pa.record_batch([batch.column("key").slice(k, 1), pa.array([whole], pa.binary())], names=["key", "bytes"])

    return parts.select("key", F.col("p.bytes").alias("parts")).mapInArrow(run, "key bigint, bytes binary")
