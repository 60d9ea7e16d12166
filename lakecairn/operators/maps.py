"""Ordered key/value maps as DataFrames: point, range and prefix reads, batches of changes, diffs.

A map is a DataFrame with unique keys; a batch of changes has a sequence number, the key,
``op`` (insert or remove) and the values. Every operator is a plain filter, join or
aggregation, so filters reach the files and keys shuffle once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.errors import DuplicateKey

INSERT, REMOVE = "insert", "remove"


def get(m: DataFrame, key: str, value) -> DataFrame:
    """The row of one key, or none."""
    return m.filter(F.col(key) == value)


def bounds(key: Column, start=None, end=None, *, start_open: bool = False, end_closed: bool = False) -> Column:
    """The predicate of a range: start included unless open, end excluded unless closed, None for no bound."""
    out = F.lit(True)
    if start is not None:
        out = out & (key > start if start_open else key >= start)
    if end is not None:
        out = out & (key <= end if end_closed else key < end)
    return out


def scan(m: DataFrame, key: str, start=None, end=None, *, start_open: bool = False, end_closed: bool = False, ordered: bool = False) -> DataFrame:
    """Rows of a range of keys, in order if asked."""
    found = m.filter(bounds(F.col(key), start, end, start_open=start_open, end_closed=end_closed))
    return found.orderBy(key) if ordered else found


def prefix(m: DataFrame, key: str, start: str) -> DataFrame:
    return m.filter(F.col(key).startswith(start))


def contains(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of df that other has."""
    return df.join(other, on, "left_semi")


def duplicates(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return m.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """m, or DuplicateKey."""
    found = duplicates(m, keys).take(1)
    if found:
        raise DuplicateKey(f"{found[0].asDict()}")
    return m


def collapse(changes: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """The last change of each key; it is combined before the shuffle, so a hot key stays cheap."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def apply(m: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """The map after a batch: base rows that no change names, and inserted rows.

    With seq, the last change of a key wins; without, keys of the batch must be unique.
    """
    if seq is not None:
        changes = collapse(changes, keys, seq)
    kept = m.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.filter(F.col("op") == INSERT).select(*m.columns))


def upsert(m: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return apply(m, rows.withColumn("op", F.lit(INSERT)), keys)


def remove(m: DataFrame, keys_to_go: DataFrame, keys: Sequence[str]) -> DataFrame:
    return m.join(keys_to_go.select(*keys), list(keys), "left_anti")


def overlay(m: DataFrame, pending: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """What a handle with pending changes reads: its last pending change of a key, else the stored row."""
    return apply(m, pending, keys, seq)


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: keys, change (added, removed, changed), and old_ and new_ values."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_new"))
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~same, "changed")
    both = a.join(b, list(keys), "full_outer").withColumn("change", change)
    return both.filter("change is not null").drop("_old", "_new")


def latest(df: DataFrame, keys: Sequence[str], seq: Column, value: Column, name: str) -> DataFrame:
    """Last writer wins: the value of the greatest seq of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(name))
