"""Connected components and small helpers for jobs that must outlive their executors."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakecairn.operators.ranges import numbered

#: Rows of a few numbers that may be broadcast, after counting them; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows of a few numbers that make a task: counted small tables are not spread over many.
TASK_ROWS = 1 << 20
#: Edges that one task may take together, after counting them; more go through rounds of joins.
ONE_TASK_EDGES = 500_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder of spark.checkpoint.dir."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Let the driver find what nothing refers to any more, so that shuffles and broadcasts of steps that are over leave the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def observed(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """checkpointed(df), and aggregates of its rows, taken as they are written."""
    seen = Observation()
    kept = checkpointed(df.observe(seen, *[c.alias(name) for name, c in sums.items()]))
    return kept, seen.get


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """checkpointed(df), and how many of its rows are so (or all)."""
    kept, seen = observed(df, n=F.count(F.lit(1) if what is None else F.when(what, 1)))
    return kept, seen["n"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lakecairn')}"
    return folder


def unique_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with ``row``, unique where doc_id is given and in its order, and whether an id repeats.

    Only then rows are numbered: rows of one id by their text's hash.
    """
    named = docs.filter("doc_id is not null")
    if few(named.groupBy("doc_id").count(), named.count()).filter("count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id")), False
    keyed = numbered(named.withColumn("_key", F.struct("doc_id", F.xxhash64("text"))), "_key", "row").drop("_key")
    rest = docs.filter("doc_id is null").withColumn("row", F.lit(None).cast("long"))
    return checkpointed(keyed.unionByName(rest)), True


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def few(df: DataFrame, n_rows: int) -> DataFrame:
    """df of n_rows rows at most, a few numbers each, in no more tasks than they are worth."""
    return df.coalesce(max(1, -(-n_rows // TASK_ROWS)))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges given, by union and find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = np.array(sorted(up), np.int64)
        yield pa.record_batch({"node": pa.array(nodes), "component": pa.array([root(x) for x in nodes.tolist()], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    A counted, bounded number of edges is joined up in one task. More go through rounds: each points
    every node at its smallest neighbour (or itself), follows the pointer once more, and contracts the
    edges; a round at least halves the nodes that still have edges.
    """
    left, n = counted(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    forget(edges.sparkSession)
    if n <= ONE_TASK_EDGES:
        return left.coalesce(1).mapInArrow(_union, "node long, component long")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        point = checkpointed(point)
        jump = point.alias("x").join(point.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.p").alias("p"))
        jump = checkpointed(jump)
        if found is None:
            found = jump.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            moved = found.join(jump, found["component"] == jump["a"], "left")
            found = checkpointed(moved.select("node", F.coalesce("p", "component").alias("component")))
        at, to = jump.select("a", F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = left.join(at, "a").join(to, "b").filter("pa <> pb")
        left = checkpointed(moved.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    return found
