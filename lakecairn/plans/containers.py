"""Typed values of a repository: counters, sets, lists, registers, text and maps with typed keys.

A container is a tree of items (k, v) and the name of its kind, stored by content id. It
can be opened by id, changed, saved, merged with another one by id, and committed under a
name in a replica; a kind says what its items mean, how two merge, and how they differ.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecairn.errors import NotFound, NotModified, UndiffableType, UnmergeableType, WrongType
from lakecairn.functions.hashing import content_id
from lakecairn.functions.values import key_of, key_text
from lakecairn.operators import maps
from lakecairn.plans.engine import ITEMS, Engine, Repo


class Kind(Protocol):
    name: str

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame: ...

    def diff(self, a: DataFrame, b: DataFrame) -> DataFrame: ...


class _Greatest:
    """Items whose values are numbers; the greatest of a key wins."""

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("k").agg(F.max(F.col("v").cast("bigint")).cast("string").alias("v"))

    def diff(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return maps.diff(a, b, ["k"])


class GCounter(_Greatest):
    """k: replica id, v: its count."""

    name = "g-counter"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items after increments (rid, n)."""
        more = rows.groupBy(F.col("rid").cast("string").alias("k")).agg(F.sum("n").cast("bigint").alias("n"))
        both = items.select("k", F.col("v").cast("bigint").alias("n")).unionByName(more)
        return both.groupBy("k").agg(F.sum("n").cast("string").alias("v"))

    def value(self, items: DataFrame) -> int:
        return items.agg(F.coalesce(F.sum(F.col("v").cast("bigint")), F.lit(0))).first()[0]


class PNCounter(_Greatest):
    """k: p/ or n/ and a replica id, v: its count of ups or downs."""

    name = "pn-counter"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items after changes (rid, n), where n may be negative."""
        side = F.concat(F.when(F.col("n") < 0, "n/").otherwise("p/"), F.col("rid").cast("string"))
        return GCounter().add(items, rows.select(side.alias("rid"), F.abs("n").alias("n")))

    def value(self, items: DataFrame) -> int:
        signed = F.when(F.col("k").startswith("p/"), F.col("v").cast("bigint")).otherwise(-F.col("v").cast("bigint"))
        return items.agg(F.coalesce(F.sum(signed), F.lit(0))).first()[0]


class ValueSet:
    """k: the value's hash, v: the value."""

    name = "set"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items and values (value)."""
        new = rows.filter("value is not null").select(content_id(F.col("value")).alias("k"), F.col("value").cast("string").alias("v"))
        return items.unionByName(new).dropDuplicates(["k"])

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).dropDuplicates(["k"])

    def diff(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return maps.diff(a, b, ["k"])


class Register(_Greatest):
    """One number, the greatest seen."""

    name = "max-register"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items after numbers (n)."""
        return self.merge(items, rows.agg(F.max("n").cast("string").alias("v")).filter("v is not null").select(F.lit("").alias("k"), "v"))

    def value(self, items: DataFrame) -> int | None:
        row = items.first()
        return int(row["v"]) if row else None


class _Plain:
    """Values that cannot be merged."""

    def merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        raise UnmergeableType(f"a {self.name} cannot be merged")

    def diff(self, a: DataFrame, b: DataFrame) -> DataFrame:
        raise UndiffableType(f"a {self.name} cannot be compared")


class ValueList(_Plain):
    """k: the place, v: the value; values may repeat."""

    name = "list"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items and values (pos, value) after them, pos from 0."""
        n = items.agg(F.coalesce(F.max(F.col("k").cast("bigint")) + 1, F.lit(0))).first()[0]
        new = rows.select(F.lpad((F.col("pos") + n).cast("string"), 19, "0").alias("k"), F.col("value").cast("string").alias("v"))
        return items.unionByName(new)


class Text(_Plain):
    """One string, empty at first."""

    name = "text"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """The text of rows (value), one row."""
        return rows.select(F.lit("").alias("k"), F.col("value").cast("string").alias("v"))

    def value(self, items: DataFrame) -> str:
        row = items.first()
        return row["v"] if row else ""


class TypedMap(_Plain):
    """A map whose keys are numbers, strings or addresses, in the order of their kinds and then their own."""

    name = "map"

    def add(self, items: DataFrame, rows: DataFrame) -> DataFrame:
        """items after changes (k: an order_key, op, v)."""
        return maps.apply(items, rows.select("k", "op", "v"), ["k"])

    def diff(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return maps.diff(a, b, ["k"])


KINDS = {k.name: k for k in (GCounter(), PNCounter(), ValueSet(), Register(), ValueList(), Text(), TypedMap())}


def describe(kind: Kind) -> dict:
    return {"name": kind.name, "params": []}


class Container:
    """A value of a kind in a store: new ones are dirty, those that were opened are not until they change."""

    def __init__(self, engine: Engine, kind: Kind | str, cid: str | None = None):
        self.engine, self.cid = engine, cid
        self.kind = KINDS[kind] if isinstance(kind, str) else kind
        self.items = engine.load(cid, self.kind.name) if cid else engine.spark.createDataFrame([], ITEMS)
        self.dirty = cid is None

    def add(self, rows: DataFrame) -> None:
        self.items, self.dirty = self.kind.add(self.items, rows), True

    def value(self):
        return self.kind.value(self.items)

    def merge(self, other: str) -> None:
        """Take in the container of that id, of the same kind."""
        self.items, self.dirty = self.kind.merge(self.items, self.engine.load(other, self.kind.name)), True

    def diff(self, other: str) -> DataFrame:
        """What is otherwise in the container of that id."""
        return self.kind.diff(self.items, self.engine.load(other, self.kind.name))

    def save(self) -> str:
        if self.dirty:
            self.cid = self.engine.save(self.kind.name, self.items)
            self.items, self.dirty = self.engine.load(self.cid, self.kind.name), False
        return self.cid

    def save_with_cids(self) -> tuple[str, list[str]]:
        """The id, and those of all that it is made of, the root first and the id itself last."""
        cid = self.save()
        root = self.engine.root_of(cid, self.kind.name)
        below = [r["addr"] for r in self.engine.leaves(root).select("addr").toLocalIterator() if r["addr"] != root]
        return cid, [root, *below, cid]

    def get(self, key: int | str | bytes) -> str | None:
        """The value of one key of a saved container."""
        name = key_text(key) if self.kind.name == "map" else str(key)
        return self.engine.lookup(self.engine.root_of(self.save(), self.kind.name), name)

    def keys(self) -> list[int | str | bytes]:
        """The keys of a typed map, in order."""
        if self.kind.name != "map":
            raise WrongType(f"a {self.kind.name} has no keys")
        return [key_of(r["k"]) for r in self.items.select("k").orderBy("k").toLocalIterator()]


class ContainerRepo(Repo):
    """A container under a name in a replica; one that was never committed is the kind's default."""

    def __init__(self, engine: Engine, name: str, kind: Kind | str, rid: str = "main"):
        super().__init__(engine, name, rid)
        self.container = Container(engine, kind, self.staged or self.tip)

    def add(self, rows: DataFrame) -> None:
        self.container.add(rows)

    def value(self):
        return self.container.value()

    def stage(self) -> str:
        if not self.container.dirty:
            raise NotModified(self.name)
        self._keep_stage(self.container.save())
        return self.staged

    def commit(self, message: str | None = None) -> str:
        """Save and publish the container; the same content as the tip adds nothing."""
        if self.container.dirty:
            self.stage()
        elif self.staged is None:
            return self.tip
        return super().commit(message)

    def merge_replica(self, rid: str) -> None:
        """Take in what another replica has under this name."""
        entry = self.engine.entry(self.engine.head(rid))
        if entry is None or self.name not in entry["tips"]:
            raise NotFound(f"{rid}/{self.name}", self.engine.path)
        self.container.merge(entry["tips"][self.name])
