"""Nested maps addressed by paths: rows (map, key, child) where a child may be a map again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.errors import CannotReplaceRootMap, DanglingAddress, WrongType
from lakecairn.functions.values import escape


def resolve(entries: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """paths (path_id, root, path array) with child_0 .. child_<depth-1>: null from the first miss on.

    One equi-join a segment; the number of segments is the path's, not the data's.
    """
    out = paths.withColumn("_at", F.col("root"))
    step = entries.select(F.col("map").alias("_at"), F.col("key").alias("_key"), F.col("child").alias("_child"))
    for i in range(depth):
        out = out.withColumn("_key", F.get("path", F.lit(i))).join(step, ["_at", "_key"], "left").withColumn(f"child_{i}", F.col("_child")).withColumn("_at", F.col("_child")).drop("_child", "_key")
    return out.drop("_at")


def wrong_type(depth: int, is_value: Callable[[Column], Column]) -> Column:
    """For rows of ``resolve``: ``WrongType`` where a path goes on below a child that is a value and no map, else null."""
    hit = F.lit(False)
    for i in range(depth - 1):
        hit = hit | ((F.size("path") > i + 1) & F.coalesce(is_value(F.col(f"child_{i}")), F.lit(False)))
    return F.when(hit, "WrongType")


def require_maps(resolved: DataFrame, depth: int, is_value: Callable[[Column], Column]) -> DataFrame:
    """resolved, or WrongType for the first path that goes on below a value."""
    bad = resolved.filter(wrong_type(depth, is_value).isNotNull()).select("path").take(1)
    if bad:
        raise WrongType(f"{'/'.join(bad[0][0])} goes on below a value")
    return resolved


def address(entries: DataFrame) -> DataFrame:
    """(map, addr): the digest of each map's sorted entries."""
    items = F.sort_array(F.collect_list(F.struct("key", "child")))
    text = F.array_join(F.transform(items, lambda x: F.concat(escape(x["key"]), F.lit("="), escape(x["child"]))), "|")
    return entries.groupBy("map").agg(F.sha2(text.cast("binary"), 256).alias("addr"))


def insert(entries: DataFrame, path: Sequence[str], value: str, root: str = "") -> DataFrame:
    """Entries after a value was put at a path; maps on the way are made where they are missing."""
    if not path:
        raise CannotReplaceRootMap("the root map cannot be replaced")
    spark = entries.sparkSession
    where, rows = root, []
    for i, key in enumerate(path):
        child = value if i == len(path) - 1 else f"{where}/{key}"
        rows.append((where, key, child))
        where = child
    new = spark.createDataFrame(rows, "map string, key string, child string")
    return entries.join(F.broadcast(new.select("map", "key")), ["map", "key"], "left_anti").select("map", "key", "child").unionByName(new)


def update(entries: DataFrame, path: Sequence[str], value: str, root: str = "") -> tuple[DataFrame, str]:
    """The entries of the new maps after a value was put at a path, each named by its address, and the new root's.

    Every map on the way is written anew, from the last one up; maps that are missing are made. Old maps stay as they are.
    """
    if not path:
        raise CannotReplaceRootMap("the root map cannot be replaced")
    spark = entries.sparkSession
    at, chain = root, [root]
    for key in path[:-1]:
        found = None if at is None else entries.filter((F.col("map") == at) & (F.col("key") == key)).select("child").take(1)
        at = found[0][0] if found else None
        chain.append(at)
    out, child = None, value
    for at, key in zip(reversed(chain), reversed(list(path))):
        old = entries.filter((F.col("map") == at) & (F.col("key") != key)).select("key", "child") if at is not None else spark.createDataFrame([], "key string, child string")
        rows = old.unionByName(spark.createDataFrame([(key, child)], "key string, child string"))
        child = address(rows.withColumn("map", F.lit("new"))).first()["addr"]
        named = rows.select(F.lit(child).alias("map"), "key", "child")
        out = named if out is None else out.unionByName(named)
    return out, child


def require_children(entries: DataFrame, is_map: Callable[[Column], Column]) -> DataFrame:
    """entries, or DanglingAddress for a child that says it is a map and has no entries."""
    asked = entries.filter(is_map(F.col("child"))).select(F.col("child").alias("map")).distinct()
    gone = asked.join(entries.select("map"), "map", "left_anti").take(1)
    if gone:
        raise DanglingAddress(gone[0][0])
    return entries
