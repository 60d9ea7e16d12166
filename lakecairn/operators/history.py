"""Logs, heads, commits and workspaces as windows over operation rows; one long log goes over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecairn.operators.ranges import is_hot, with_before, with_last


def link(log: DataFrame, by: str, order: list[str], addr: str = "addr", name: str = "prev", hot: bool | None = None) -> DataFrame:
    """Each entry with the address of the one before it in its log."""
    return with_before(log, [by], order, {name: addr}, hot)


def head(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The newest entry of each log; combined before the shuffle."""
    rest = [c for c in log.columns if c != by]
    newest = log.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return newest.select(by, *[F.col(f"_e.{c}").alias(c) for c in rest])


def changed(log: DataFrame, by: str, order: list[str], content: str, hot: bool | None = None) -> DataFrame:
    """Entries whose content differs from the one before: committing the same content again adds nothing."""
    return written(log, by, order, content, hot).filter("_written").drop("_written")


def written(log: DataFrame, by: str, order: list[str], content: str, hot: bool | None = None) -> DataFrame:
    """Entries with ``_written``: whether each differs from the one before."""
    rows = with_before(log, [by], order, {"_before": content}, hot)
    return rows.withColumn("_written", F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(content))).drop("_before")


def tips(log: DataFrame, by: list[str], order: list[str], tip: str, hot: bool | None = None) -> DataFrame:
    """Upserts of a tip, with whether each changed it."""
    rows = with_before(log, by, order, {"_before": tip}, hot)
    return rows.withColumn("dirty", ~F.col("_before").eqNullSafe(F.col(tip))).drop("_before")


def replay(ops: DataFrame, by: str, order: list[str], action: str = "action", addr: str = "addr", hot: bool | None = None) -> DataFrame:
    """Workspace states after each stage or commit: status, staged, commit, and the commit's error if any.

    A commit takes what was staged since the commit before; without that it fails and changes nothing.
    """
    hot = is_hot(ops, [by]) if hot is None else hot
    staged = F.col(action) == "stage"
    rows = with_before(ops, [by], order, {"_before": action}, hot)
    # Only a stage right before makes a commit valid: any commit, good or failed, leaves nothing staged.
    rows = rows.withColumn("_ok", ~staged & F.coalesce(F.col("_before") == "stage", F.lit(False)))
    rows = with_last(rows.withColumn("_commit", F.when(F.col("_ok"), F.col(addr))), [by], order, "_commit", "commit", hot)
    return rows.select(
        *ops.columns,
        F.when(staged & F.col("commit").isNull(), "init_staged").when(staged, "staged").when(F.col("commit").isNull(), "init").otherwise("clean").alias("status"),
        F.when(staged, F.col(addr)).alias("staged"),
        "commit",
        F.when(~staged & ~F.col("_ok"), "CommitEmptyStage").alias("error"),
    )


def visible(staged: Column, committed: Column) -> Column:
    """The content a reader sees: what is staged, else what the head commit holds."""
    return F.coalesce(staged, committed)


def walk(log: DataFrame, by: str, start: str, order: list[str]) -> DataFrame:
    """History of one log, newest first, by its order instead of link by link."""
    return log.filter(F.col(by) == start).orderBy(*[F.desc(c) for c in order])
