"""Hash sets and ordered bags of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakecairn.errors import InvalidInput
from lakecairn.functions.hashing import content_id
from lakecairn.operators.ranges import numbered


def create(values: DataFrame, value: str) -> DataFrame:
    """The distinct values with their hash, which is the set's order."""
    return values.select(F.col(value).alias("value")).filter("value is not null").distinct().select(content_id(F.col("value")).alias("hash"), "value")


def ordered(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """The values with their rank, from 1, by hash."""
    return numbered(values, "hash", "rank", partitions).withColumn("rank", (F.col("rank") + 1).cast("int"))


def contains(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with whether the set has each value."""
    return wanted.join(values.select("value", F.lit(True).alias("_in")), "value", "left").select("value", F.coalesce("_in", F.lit(False)).alias("contained"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("value"), "value", "left_anti").select(*a.columns)


def update(values: DataFrame, changes: DataFrame) -> DataFrame:
    """The set after changes (seq, op, value) in order: the last operation on a value decides."""
    base = values.select("value", F.lit(-1).cast("bigint").alias("seq"), F.lit("insert").alias("op"))
    both = base.unionByName(changes.select("value", F.col("seq").cast("bigint").alias("seq"), "op"))
    last = both.groupBy("value").agg(F.max_by("op", "seq").alias("op")).filter("op = 'insert'")
    return create(last, "value")


def positions(rows: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """An ordered bag: every row keeps its place, duplicates too. One bag a group, or one of all rows."""
    if group is None:
        return numbered(rows, order, "pos")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint") - 1)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag b after bag a (columns pos and others)."""
    n = a.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_n"))
    return a.unionByName(b.join(F.broadcast(n)).withColumn("pos", F.col("pos") + F.col("_n")).drop("_n"))


def read(rows: DataFrame) -> DataFrame:
    return rows.orderBy("pos")


def one_kind(rows: DataFrame, kind: str, wanted: str) -> DataFrame:
    """rows, or InvalidInput where their kind is not the wanted one."""
    other = rows.filter(F.col(kind) != wanted).select(kind).take(1)
    if other:
        raise InvalidInput(f"{other[0][0]} among {wanted}")
    return rows
