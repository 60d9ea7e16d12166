"""Content-addressed search trees over sorted key/value rows.

An item ends its block when its own digest says so, so blocks depend on content alone:
any order of changes that leads to the same rows leads to the same root, and a change
rewrites only the blocks around it. The level is part of a node's text; the empty map is
a fixed leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakecairn.functions.values import escape
from lakecairn.operators.lineage import cut
from lakecairn.operators.ranges import ranged, running, with_next

#: Bits of an item's digest that must be set for it to end a block: 2**BITS items a block on average.
BITS = 4


def ends_block(key: Column, value: Column, bits: int = BITS) -> Column:
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", key, value).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    mask = (1 << bits) - 1
    return head.bitwiseAND(F.lit(mask)) == mask


def block_ids(items: DataFrame, key: str, ends: str, out: str = "block", partitions: int | None = None) -> DataFrame:
    """Number blocks 0, 1, ... along the order of key; a row whose ``ends`` is true is its block's last."""
    return running(items, key, F.when(F.col(ends), 1).otherwise(0), out, partitions)


def node_text(level: int, items: Column) -> Column:
    """The text that a node's address is the digest of; items are structs (k, v), v null-free."""
    return F.concat(F.lit(f"L{level}:"), F.array_join(F.transform(items, lambda x: F.concat(escape(x["k"]), F.lit("="), escape(x["v"]))), "|"))


def blocks(items: DataFrame, level: int, bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """Nodes of one level from items (k, v): block, first_key, n, items, addr."""
    numbered = block_ids(items.withColumn("_end", ends_block(F.col("k"), F.col("v"), bits)), "k", "_end", partitions=partitions)
    return _nodes(numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("items")), level)


def _nodes(grouped: DataFrame, level: int) -> DataFrame:
    return grouped.select(
        F.lit(level).alias("level"),
        "block",
        F.col("items")[0]["k"].alias("first_key"),
        F.size("items").alias("n"),
        "items",
        F.sha2(node_text(level, F.col("items")).cast("binary"), 256).alias("addr"),
    )


def build(items: DataFrame, bits: int = BITS) -> DataFrame:
    """All nodes of the tree over items (k, v), keys unique; the root is the one node of the last level."""
    leaves = cut(blocks(items, 0, bits))
    return empty(items.sparkSession) if leaves.isEmpty() else _levels(leaves, bits)


def empty(spark: SparkSession) -> DataFrame:
    """The tree of the empty map: one leaf without items."""
    leaf = spark.createDataFrame([(0, 0, None, 0, [])], "level int, block bigint, first_key string, n int, items array<struct<k: string, v: string>>")
    return leaf.withColumn("addr", F.sha2(node_text(0, F.col("items")).cast("binary"), 256))


def _levels(leaves: DataFrame, bits: int) -> DataFrame:
    """Leaves and the levels above them, up to one node.

    A level that does not shrink (two nodes, the first of which ends its block) is followed by the next
    like any other: a node's digest changes with its level, so nodes come together in the end.
    """
    if bits < 1:
        raise ValueError("bits must be at least 1: else every item ends its block, and no level shrinks")
    level, nodes, out = 0, leaves, leaves
    count = nodes.count()
    while count > 1:
        level += 1
        nodes = cut(blocks(nodes.select(F.col("first_key").alias("k"), F.col("addr").alias("v")), level, bits))
        out, count = out.unionByName(nodes), nodes.count()
    return out


def root(nodes: DataFrame) -> DataFrame:
    """level and addr of the root."""
    return nodes.orderBy(F.desc("level")).limit(1).select("level", F.col("addr").alias("root"))


def scan(nodes: DataFrame) -> DataFrame:
    """The items (k, v) of a tree, from its leaves."""
    return nodes.filter("level = 0").select(F.explode("items").alias("i")).select("i.k", "i.v")


def get(nodes: DataFrame, key: str) -> DataFrame:
    """The item of one key, from the one leaf that may hold it."""
    leaf = nodes.filter((F.col("level") == 0) & (F.col("first_key") <= key)).orderBy(F.desc("first_key")).limit(1)
    return leaf.select(F.explode("items").alias("i")).select("i.k", "i.v").filter(F.col("k") == key)


def neighbours(leaves: DataFrame, partitions: int | None = None) -> DataFrame:
    """Leaves with next_key, the first key of the right neighbour (null at the end)."""
    return with_next(leaves, "first_key", "next_key", partitions)


def block_of(keys: DataFrame, key: str, leaves: DataFrame) -> DataFrame:
    """Each key with the block that holds or would hold it: the last block whose first key is not after it.

    Blocks and keys are merged in one ordered pass over ranges, so no pair of them is ever formed:
    a block starts a range of keys, and a range carries the last block before it along.
    """
    marks = leaves.select(F.col("first_key").alias("_k"), F.lit(0).alias("_kind"), F.col("block").alias("_block"), F.lit(None).cast(dict(keys.dtypes)[key]).alias(key))
    rows = keys.select(F.col(key).alias("_k"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_block"), key)
    both = ranged(marks.unionByName(rows), "_k", "_kind")
    last = both.filter("_kind = 0").groupBy("_range").agg(F.max_by("_block", "_k").alias("_last"))
    ranges = both.select("_range").distinct().join(last, "_range", "left")
    carried = ranges.select("_range", F.last("_last", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    near = F.last("_block", ignorenulls=True).over(Window.partitionBy("_range").orderBy("_k", "_kind"))
    found = both.withColumn("_near", near).join(F.broadcast(carried), "_range").filter("_kind = 1")
    return found.select(key, F.coalesce("_near", "_carry").alias("block"))


def update(nodes: DataFrame, changes: DataFrame, bits: int = BITS) -> DataFrame:
    """The tree after changes (k, op, v; keys unique), taking apart only the leaves that they touch.

    A change opens the leaf its key belongs to; when a leaf's last item changes, the leaf no longer
    ends there and the next one opens too. All other leaves keep their addresses, and between two
    opened runs there is always an end, so the opened items are cut as in a full build.
    """
    leaves = nodes.filter("level = 0 and n > 0")
    inserts = changes.filter("op = 'insert'").select("k", "v")
    if leaves.isEmpty():
        return build(inserts, bits)
    last = F.element_at("items", -1)
    edge = leaves.select("block", last["k"].alias("last_key"), ends_block(last["k"], last["v"], bits).alias("closed"))
    near = block_of(changes.select("k"), "k", leaves).select("k", F.coalesce("block", F.lit(0)).cast("bigint").alias("block"))
    at = near.join(edge, "block")
    after = F.col("closed") & (F.col("k") >= F.col("last_key"))
    opened = at.filter(~after | (F.col("k") == F.col("last_key"))).select("block").unionByName(at.filter(after).select((F.col("block") + 1).alias("block")))
    opened = cut(opened.distinct())
    items = leaves.join(opened, "block", "left_semi").select(F.explode("items").alias("i")).select("i.k", "i.v")
    items = items.join(changes.select("k"), "k", "left_anti").unionByName(inserts)
    kept = leaves.join(opened, "block", "left_anti")
    merged = cut(kept.drop("block").unionByName(blocks(items, 0, bits).drop("block")).withColumn("_end", F.lit(True)))
    if merged.isEmpty():
        return empty(nodes.sparkSession)
    return _levels(cut(block_ids(merged, "first_key", "_end").drop("_end").select(*nodes.columns)), bits)
