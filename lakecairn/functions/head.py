"""The text form of a workspace's head: a branch, perhaps with staged content, or a detached address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of the text form.
BRANCH, STAGED, DETACHED, SEP = "branch", "staged_content", "detached", ": "


def to_text(branch: Column, staged: Column, detached: Column) -> Column:
    on_branch = F.concat(F.lit(BRANCH + SEP), branch, F.coalesce(F.concat(F.lit("\n" + STAGED + SEP), staged), F.lit("")))
    return F.coalesce(F.concat(F.lit(DETACHED + SEP), detached), on_branch)


def from_text(text: Column) -> Column:
    """struct(branch, staged, detached); text of another form raises."""
    ok = text.rlike(rf"\A(?:{DETACHED}{SEP}[^\n]+|{BRANCH}{SEP}[^\n]*(?:\n{STAGED}{SEP}[^\n]+)?)\n?\z")
    part = lambda key: F.nullif(F.regexp_extract(text, rf"(?m)^{key}{SEP}(.*)$", 1), F.lit(""))
    found = F.struct(part(BRANCH).alias("branch"), part(STAGED).alias("staged"), part(DETACHED).alias("detached"))
    return F.when(text.isNull() | ok, found).otherwise(F.raise_error(F.lit("unknown head")).cast("struct<branch: string, staged: string, detached: string>"))
