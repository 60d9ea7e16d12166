"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakecairn.operators.lineage import shared_folder
from lakecairn.plans.engine import Engine
from lakecairn.plans.registry import query
from lakecairn.sources.store import ContentStore
from lakecairn.streaming import ingest

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"


def _events(spark, d):
    return spark.readStream.schema(_SCHEMA).parquet(f"{d}/events.parquet*")


def _drain(stream, sink):
    """Run a stream to its end; both its progress and its result lie in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query_ = ingest.start(stream, sink(f"{folder}/out"), f"{folder}/progress")
    query_.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out/*")


@query("select event_type as counter, user_id as rid, count(*) as n from events group by all")
def stream_gcounter(spark, d):
    """Each micro-batch adds its increments; the sum of them is the counter, a batch that runs again replaces its own."""
    add = lambda out: lambda batch, epoch: ingest.counts(batch, "event_type", "user_id").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return _drain(_events(spark, d), add).groupBy("counter", "rid").agg(F.sum("n").cast("bigint").alias("n"))


@query("select user_id::varchar as k, arg_max(event_type, event_id) as v from events group by user_id")
def stream_upsert(spark, d):
    """Last write of each key over all micro-batches, as commits of a repository."""
    engine = Engine.init(spark, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    repo = engine.repo("events")
    sink = ingest.upsert_sink(repo, "user_id", "event_type", "event_id")
    ingest.start(_events(spark, d), sink, f"{engine.path}/progress").awaitTermination()
    return engine.repo("events").read()


@query("select distinct sha256(props) as cid, octet_length(encode(props))::bigint as n_bytes from events where props is not null")
def stream_blobs(spark, d):
    """New blobs of a stream by content id."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store = ContentStore(spark, f"{folder}/blobs")
    stream = spark.readStream.schema("event_id bigint, props string").parquet(f"{d}/events.parquet*")
    ingest.start(stream, ingest.blob_sink(store, "props"), f"{folder}/progress").awaitTermination()
    return store.frame().select("cid", F.octet_length("bytes").cast("bigint").alias("n_bytes"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by all")
def stream_windowed(spark, d):
    """Counts by hour and type; each micro-batch replaces the windows that it changed."""
    rows = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    counted = ingest.windowed(rows, "at", "event_type").select(F.col("window.start").alias("hour"), "event_type", "n")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out/*")
    last = out.groupBy("hour", "event_type").agg(F.max_by("n", "epoch").alias("n"))
    return last.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
