"""Listings of string keys, by prefix and by delimiter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(df: DataFrame, key: str, prefix: str = "", delimiter: str | None = None) -> DataFrame:
    """Keys with a prefix; with a delimiter, keys that hold it after the prefix give their common start once."""
    found = df.filter(F.col(key).startswith(prefix)).select(F.col(key).alias("key"))
    if not delimiter:
        return found.distinct()
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    at = F.instr(rest, delimiter)
    group = F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))
    return found.select(F.when(at > 0, group).otherwise(F.col("key")).alias("key")).distinct()
