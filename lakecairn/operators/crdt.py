"""Mergeable counters and clocks, and the protocol of mergeable values.

A counter is rows (counter, rid, n): merging takes the greatest n of each rid, so it is
commutative, associative and idempotent, and one aggregation with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.errors import UndiffableType, UnmergeableType


def increments(ops: DataFrame, counter: str, rid: str) -> DataFrame:
    """Counters from one row an increment."""
    return ops.groupBy(F.col(counter).alias("counter"), F.col(rid).alias("rid")).agg(F.count("*").alias("n"))


def value(counters: DataFrame) -> DataFrame:
    return counters.groupBy("counter").agg(F.sum("n").cast("bigint").alias("value"))


def get(counters: DataFrame, counter: Any, rid: Any) -> DataFrame:
    return counters.filter((F.col("counter") == counter) & (F.col("rid") == rid))


def merge(*states: DataFrame) -> DataFrame:
    """The join of counter states."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("counter", "rid").agg(F.max("n").alias("n"))


def pn_value(ups: DataFrame, downs: DataFrame) -> DataFrame:
    """Ups less downs of each counter; it may be negative."""
    signed = ups.select("counter", "n").unionByName(downs.select("counter", (-F.col("n")).alias("n")))
    return signed.groupBy("counter").agg(F.sum("n").cast("bigint").alias("value"))


def compare_clocks(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("clock",)) -> DataFrame:
    """equal, before, after or concurrent, for each clock of rows (keys, rid, n); a missing rid counts 0."""
    both = left.withColumnRenamed("n", "l").join(right.withColumnRenamed("n", "r"), [*keys, "rid"], "full_outer")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))  # noqa: E741
    folded = both.groupBy(*keys).agg(F.max((l < r).cast("int")).alias("_lt"), F.max((l > r).cast("int")).alias("_gt"))
    order = F.when((F.col("_lt") == 1) & (F.col("_gt") == 1), "concurrent").when(F.col("_lt") == 1, "before").when(F.col("_gt") == 1, "after").otherwise("equal")
    return folded.select(*keys, order.alias("ordering"))


class Mergeable(Protocol):
    """A value with a zero, a join, and a difference; join must be commutative, associative and idempotent."""

    def zero(self) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def diff(self, a: Any, b: Any) -> Any: ...

    def describe(self) -> dict: ...


class MaxRegister:
    """The greatest value seen."""

    #: The join as an aggregate of Spark's own; values without one are merged in Python.
    native = staticmethod(F.max)

    def zero(self) -> Any:
        return None

    def merge(self, a: Any, b: Any) -> Any:
        return b if a is None else a if b is None else max(a, b)

    def diff(self, a: Any, b: Any) -> Any:
        return None if a == b else (a, b)

    def describe(self) -> dict:
        return {"name": "max-register", "params": []}


class Opaque:
    """A value that has no join, as plain text."""

    def zero(self) -> Any:
        return ""

    def merge(self, a: Any, b: Any) -> Any:
        raise UnmergeableType("plain values cannot be merged")

    def diff(self, a: Any, b: Any) -> Any:
        raise UndiffableType("plain values cannot be compared")

    def describe(self) -> dict:
        return {"name": "opaque", "params": []}


def merge_by(df: DataFrame, keys: Sequence[str], col: str, kind: Mergeable, salts: int = 16) -> DataFrame:
    """One merged value a key: partitions first, then pieces of a key, then the key, so that no task sees all its rows."""
    if hasattr(kind, "native"):
        return df.groupBy(*keys).agg(kind.native(F.col(col)).alias(col))
    schema = df.select(*keys, col).schema

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: dict[tuple, Any] = {}
            for *k, v in f[[*keys, col]].itertuples(index=False, name=None):
                rows[tuple(k)] = kind.merge(rows.get(tuple(k), kind.zero()), v)
            if rows:
                yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=[*keys, col])

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        out = kind.zero()
        for v in f[col]:
            out = kind.merge(out, v)
        return pd.DataFrame([(*f[list(keys)].iloc[0], out)], columns=[*keys, col])

    some = df.select(*keys, col).mapInPandas(partial, schema).withColumn("_salt", F.spark_partition_id() % salts)
    some = some.groupBy(*keys, "_salt").applyInPandas(lambda f: whole(f.drop(columns="_salt")), schema)
    return some.groupBy(*keys).applyInPandas(whole, schema)


def is_sorted(c: Column, before: Column) -> Column:
    """Whether a value is not before the one in front of it."""
    return before.isNull() | (before <= c)
