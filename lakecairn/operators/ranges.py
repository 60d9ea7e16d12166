"""Order over a whole table without one task for all of it: ranges of keys, plus a table of one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecairn.operators.lineage import cut

#: Rows that one task may order.
ONE_TASK = 10_000


def _all() -> Window:
    """A window over a table of one row a range."""
    return Window.partitionBy(F.lit(0)).orderBy("_range")


def ranged(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """df dealt into ranges of its keys, with ``_range`` in their order; kept, so that the ranges stay as they are."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return cut(dealt.withColumn("_range", F.spark_partition_id()))


def small(df: DataFrame) -> bool:
    return df.limit(ONE_TASK + 1).count() <= ONE_TASK


def running(df: DataFrame, key: str, amount: Column, out: str, partitions: int | None = None) -> DataFrame:
    """df with the sum of amount over all rows before each, by key."""

    def before(window: Window) -> Column:
        return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")

    if partitions is None and small(df):
        return df.withColumn(out, before(Window.partitionBy(F.lit(0)).orderBy(key)))
    rows = ranged(df, key, partitions=partitions)
    totals = rows.groupBy("_range").agg(F.sum(amount).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(_all().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    offsets = totals.select("_range", offset.alias("_offset"))
    own = rows.withColumn("_own", before(Window.partitionBy("_range").orderBy(key)))
    return own.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_range")


def numbered(df: DataFrame, key: str, out: str, partitions: int | None = None) -> DataFrame:
    """df with each row's place, from 0, by key."""
    return running(df, key, F.lit(1), out, partitions)


def with_next(df: DataFrame, key: str, out: str, partitions: int | None = None) -> DataFrame:
    """df with the key of the next row, null at the end."""
    if partitions is None and small(df):
        return df.withColumn(out, F.lead(key).over(Window.partitionBy(F.lit(0)).orderBy(key)))
    rows = ranged(df, key, partitions=partitions)
    firsts = rows.groupBy("_range").agg(F.min(key).alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(_all()).alias("_after"))
    own = rows.withColumn(out, F.lead(key).over(Window.partitionBy("_range").orderBy(key)))
    return own.join(F.broadcast(after), "_range").withColumn(out, F.coalesce(out, "_after")).drop("_range", "_after")


#: Rows of one log from which it is dealt out over several tasks.
HOT_LOG = 1_000_000


def is_hot(df: DataFrame, by: list[str]) -> bool:
    """Whether a log is too long for one task."""
    return not df.groupBy(*by).count().filter(F.col("count") > HOT_LOG).isEmpty()


def _named(by: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)])


def with_before(df: DataFrame, by: list[str], order: list[str], cols: dict[str, str], hot: bool | None = None) -> DataFrame:
    """df with columns (new name: column) of the row before in its log (by), in order; null at a log's start.

    A log that is too long for one task goes over ranges of rows, each of which takes on the last row before it.
    """
    if not (is_hot(df, by) if hot is None else hot):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(name) for name, c in cols.items()])
    rows = ranged(df, *by, *order)
    last = rows.groupBy("_range").agg(F.max_by(F.struct(_named(by).alias("by"), *[F.col(c).alias(name) for name, c in cols.items()]), F.struct(*by, *order)).alias("_e"))
    carry = last.select("_range", F.lag("_e").over(_all()).alias("_carry"))
    w = Window.partitionBy("_range", *by).orderBy(*order)
    own = rows.withColumn("_first", F.row_number().over(w) == 1).select("*", *[F.lag(c).over(w).alias(name) for name, c in cols.items()])
    own = own.join(F.broadcast(carry), "_range")
    goes_on = F.col("_first") & _named(by).eqNullSafe(F.col("_carry.by"))
    for name in cols:
        own = own.withColumn(name, F.when(goes_on, F.col(f"_carry.{name}")).otherwise(F.col(name)))
    return own.drop("_range", "_first", "_carry")


def with_last(df: DataFrame, by: list[str], order: list[str], col: str, out: str, hot: bool | None = None) -> DataFrame:
    """df with the last value of col that is not null, up to and with each row of its log (by), in order."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not (is_hot(df, by) if hot is None else hot):
        return df.withColumn(out, F.last(col, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)))
    rows = ranged(df, *by, *order)
    key, place = _named(by), F.struct(*by, *order)
    ends = rows.groupBy("_range").agg(F.max_by(key, place).alias("_by"), F.min_by(key, place).alias("_from"))
    value = rows.filter(F.col(col).isNotNull()).groupBy("_range").agg(F.max_by(F.struct(key.alias("by"), F.col(col).alias("v")), place).alias("_e"))
    table = ends.join(value, "_range", "left")
    # Only the log that a range ends in goes on after it; its last value is the range's last one, if that is of this log.
    mine = F.when(F.col("_e.by").eqNullSafe(F.col("_by")), F.col("_e.v"))
    seen = Window.partitionBy("_by").orderBy("_range").rowsBetween(*upto)
    table = table.withColumn("_v", F.last(mine, ignorenulls=True).over(seen))
    carry = table.select("_range", F.lag(F.struct("_by", "_v")).over(_all()).alias("_carry"))
    w = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(*upto)
    own = rows.withColumn(out, F.last(col, ignorenulls=True).over(w)).join(F.broadcast(carry), "_range")
    filled = F.when(key.eqNullSafe(F.col("_carry._by")), F.col("_carry._v"))
    return own.withColumn(out, F.coalesce(out, filled)).drop("_range", "_carry")
