"""Streams into versioned state. Every sink is safe to replay."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakecairn.operators import maps
from lakecairn.plans.engine import Repo
from lakecairn.sources.store import ContentStore


def upsert_sink(repo: Repo, key: str, value: str, seq: str):
    """foreachBatch: the last row of each key of a micro-batch goes into the map, as one commit.

    A batch that runs again writes the same content, which adds no version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.select(F.col(seq).alias("seq"), F.col(key).cast("string").alias("k"), F.lit(maps.INSERT).alias("op"), F.col(value).cast("string").alias("v"))
        repo.change(maps.collapse(rows, ["k"]).select("k", "op", "v"))
        repo.stage()
        repo.commit()

    return write


def blob_sink(store: ContentStore, data: str):
    """foreachBatch: new blobs by content id."""
    return lambda batch, epoch: store.put(batch, data)


def start(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Run what is there now, then stop."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.start()


def counts(stream: DataFrame, counter: str, rid: str) -> DataFrame:
    """A grow-only counter over a stream, for update mode."""
    return stream.groupBy(F.col(counter).alias("counter"), F.col(rid).alias("rid")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are left out and windows close."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


class LastWrite(StatefulProcessor):
    """Last writer wins, by seq: emits a key's value whenever it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        best = old
        for frame in rows:
            for seq, value in frame[["seq", "value"]].itertuples(index=False):
                if best is None or seq > best[0]:
                    best = (int(seq), value)
        if best is not None and best != old:
            self.last.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def last_writes(stream: DataFrame) -> DataFrame:
    """stream (key string, seq long, value string) as changes of each key's last value (needs the RocksDB state store)."""
    return stream.groupBy("key").transformWithStateInPandas(LastWrite(), "key string, seq long, value string", "Update", "None")
