"""A repository of versioned values on a shared folder: init, open, stage, commit, history.

Blobs and tree nodes are immutable; a commit writes nodes, then the log row, then the
head, so a crash leaves only rows that nothing points to. The head is swapped only if it
is still the one that the commit began with. What a repository's tip is stands in the log
row that the head points at, for every repository of the replica.

Nodes lie in folders by level and address. A version is read by descent from its root: a
key opens one node a level, a range the nodes that may hold a part of it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakecairn.errors import CannotReplaceRootMap, CommitEmptyStage, DanglingAddress, DetachedHead, InUse, NoChangesToWrite, NotFound, WrongType
from lakecairn.functions.hashing import content_id
from lakecairn.operators import maps, tree
from lakecairn.operators.chunking import MAX_SIZE, MEAN_SIZE, MIN_SIZE, assemble, chunks, index
from lakecairn.operators.ranges import numbered
from lakecairn.sources.store import ContentStore, MetaStore, _read

NODE = "first_key string, n int, items array<struct<k: string, v: string>>, addr string, level int, shard string"
LOG = "addr string, prev string, remote string, replica string, repo string, tip string, message string, ts bigint, n bigint, tips map<string,string>"
ITEMS = "k string, v string"


class Engine:
    def __init__(self, spark: SparkSession, path: str, remote: str = "local", clock: Callable[[], float] = time.time):
        self.spark, self.path, self.remote, self.clock = spark, path.rstrip("/"), remote, clock
        self.blobs = ContentStore(spark, f"{self.path}/blobs")
        self.meta = MetaStore(spark, f"{self.path}/meta")

    @classmethod
    def init(cls, spark: SparkSession, path: str, **kw) -> Engine:
        engine = cls(spark, path, **kw)
        engine.meta.put("format", b"2")
        return engine

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kw) -> Engine:
        engine = cls(spark, path, **kw)
        engine.meta.get("format")
        return engine

    def head(self, rid: str) -> str | None:
        try:
            return self.meta.head(self.remote, rid)
        except NotFound:
            return None

    def repo(self, name: str, rid: str = "main") -> Repo:
        return Repo(self, name, rid)

    def log(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/log", LOG)

    def entry(self, addr: str | None) -> Row | None:
        """The log row of an address."""
        if addr is None:
            return None
        rows = self.log().filter(F.col("addr") == addr).take(1)
        if not rows:
            raise DanglingAddress(addr)
        return rows[0]

    def live(self, rid: str) -> DataFrame:
        """The log rows of a replica that its head leads to. A row of a commit that broke off has none after it."""
        rows = self.log().filter((F.col("replica") == rid) & (F.col("remote") == self.remote))
        after = rows.select(F.col("prev").alias("addr")).unionByName(self.spark.createDataFrame([(self.head(rid),)], "addr string"))
        return rows.join(after.filter("addr is not null").distinct(), "addr", "left_semi")

    def nodes(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/nodes", NODE)

    def node(self, addr: str) -> Row:
        """One node, from its folder."""
        rows = self.nodes().filter((F.col("shard") == addr[:2]) & (F.col("addr") == addr)).take(1)
        if not rows:
            raise DanglingAddress(addr)
        return rows[0]

    def leaves(self, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """The leaves (first_key, n, items, addr) of a version, or those that may hold a part of a range of keys."""
        top = self.node(root)
        found = self.spark.createDataFrame([(top["first_key"], top["n"], top["items"], root)], "first_key string, n int, items array<struct<k: string, v: string>>, addr string")
        for level in range(top["level"] - 1, -1, -1):
            after = F.get(F.col("items.k"), F.col("i") + 1)
            child = found.select("items", F.posexplode("items").alias("i", "c")).select(F.col("c.k").alias("k"), F.col("c.v").alias("addr"), after.alias("next"))
            if start is not None:
                child = child.filter(F.col("next").isNull() | (F.col("next") > start))
            if end is not None:
                child = child.filter(F.col("k") <= end)
            asked = child.select("addr", F.substring("addr", 1, 2).alias("shard"))
            stored = self.nodes().filter(F.col("level") == level)
            found = stored.join(asked, ["shard", "addr"]).dropDuplicates(["addr"]).select("first_key", "n", "items", "addr")  # two writers may store one node twice
        return found

    def items(self, root: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """The items (k, v) of a version, or of the leaves of a range."""
        return self.leaves(root, start, end).select(F.explode("items").alias("i")).select("i.k", "i.v")

    def lookup(self, root: str, key: str) -> str | None:
        """The value of one key: one node a level is read."""
        node = self.node(root)
        while node["level"]:
            before = [c["v"] for c in node["items"] if c["k"] <= key]
            if not before:
                return None
            node = self.node(before[-1])
        return next((c["v"] for c in node["items"] if c["k"] == key), None)

    def write_tree(self, nodes: DataFrame) -> str:
        """Store a version's new nodes; returns the root's address."""
        address = tree.root(nodes).first()["root"]
        known = self.nodes().filter((F.col("shard") == address[:2]) & (F.col("addr") == address))
        if known.isEmpty():
            named = nodes.select("first_key", "n", "items", "addr", "level", F.substring("addr", 1, 2).alias("shard"))
            new = named.join(self.nodes().select("level", "shard", "addr"), ["level", "shard", "addr"], "left_anti")
            new.select(*[x.split()[0] for x in ("first_key", "n", "items", "addr", "level", "shard")]).hint("rebalance", "level", "shard").write.mode("append").partitionBy("level", "shard").parquet(f"{self.path}/nodes")
        return address

    def change_tree(self, base: str | None, changes: DataFrame) -> str:
        """The version after changes (k, op, v; keys unique); only leaves that they touch are taken apart."""
        if base is None:
            return self.write_tree(tree.build(changes.filter("op = 'insert'").select("k", "v")))
        leaves = self.leaves(base)
        placed = numbered(leaves.filter("n > 0"), "first_key", "block").withColumn("level", F.lit(0))
        return self.write_tree(tree.update(placed.select("level", "block", "first_key", "n", "items", "addr"), changes))

    def put_bytes(self, data: DataFrame, key: str, col: str, sizes: tuple[int, int, int] = (MIN_SIZE, MEAN_SIZE, MAX_SIZE)) -> DataFrame:
        """Store byte strings in chunks; returns their index."""
        cut = chunks(data, key, col, *sizes)
        self.blobs.put(cut)
        return index(cut)

    def get_bytes(self, indexed: DataFrame) -> DataFrame:
        return assemble(indexed, self.blobs.frame().select("cid", "bytes"))

    def save(self, kind: str, items: DataFrame) -> str:
        """Store a value of a kind by its items (k, v); returns the id of its description."""
        text = json.dumps({"kind": kind, "root": self.write_tree(tree.build(items))}, sort_keys=True).encode()
        return self.blobs.put(self.spark.createDataFrame([(bytearray(text),)], "bytes binary")).first()["cid"]

    def load(self, cid: str, kind: str) -> DataFrame:
        """The items of a stored value; WrongType if it is of another kind."""
        return self.items(self.root_of(cid, kind))

    def root_of(self, cid: str, kind: str) -> str:
        try:
            found = json.loads(self.blobs.get(cid))
        except NotFound as e:
            raise DanglingAddress(cid) from e
        if found["kind"] != kind:
            raise WrongType(f"{cid} is a {found['kind']}, not a {kind}")
        return found["root"]


class Repo:
    """One map of a replica, as a working copy: pending changes, a staged version, the committed tip."""

    def __init__(self, engine: Engine, name: str, rid: str):
        self.engine, self.name, self.rid = engine, name, rid
        self.start = engine.head(rid)
        entry = engine.entry(self.start)
        self.tip = entry["tips"].get(name) if entry else None
        self.detached: str | None = None
        self.staged = self._kept_stage()
        self._pending: DataFrame | None = None
        self._seq = 0

    def _kept_stage(self) -> str | None:
        """What another handle, or another process, staged and did not commit."""
        try:
            return self.engine.meta.get(f"staged/{self.rid}/{self.name}").decode() or None
        except NotFound:
            return None

    def _keep_stage(self, root: str | None) -> None:
        self.staged = root
        self.engine.meta.put(f"staged/{self.rid}/{self.name}", (root or "").encode())

    @property
    def root(self) -> str | None:
        """The version that is read: the one checked out, else what is staged, else the tip."""
        return self.detached or self.staged or self.tip

    def status(self) -> dict[str, str | None]:
        state = "detached" if self.detached else ("staged" if self.tip else "init_staged") if self.staged else "clean" if self.tip else "init"
        return {"status": state, "commit": self.tip, "staged": self.staged, "content": self.root}

    def checkout(self, root: str | None) -> None:
        """Read a version as it was; None goes back to the branch. A version that is checked out cannot be committed on."""
        if root is not None:
            self.engine.node(root)
        self.detached = root

    def visible(self) -> DataFrame:
        """Items (k, v) of the version that is read, or none."""
        return self.engine.items(self.root) if self.root else self.engine.spark.createDataFrame([], ITEMS)

    def _change(self, rows: list[tuple[str, str, str | None]]) -> None:
        self.change(self.engine.spark.createDataFrame(rows, "k string, op string, v string"))

    def insert(self, key: str, value: str) -> None:
        self._change([(key, maps.INSERT, value)])

    def remove(self, key: str) -> None:
        self._change([(key, maps.REMOVE, None)])

    def change(self, changes: DataFrame) -> None:
        """A batch (k, op, v), after what is pending."""
        self._seq += 1
        new = changes.select(F.lit(self._seq).cast("bigint").alias("seq"), "k", "op", "v")
        self._pending = new if self._pending is None else self._pending.unionByName(new)

    def read(self) -> DataFrame:
        """Visible items with this handle's pending changes on top."""
        base = self.visible()
        return base if self._pending is None else maps.overlay(base, self._pending, ["k"])

    def get(self, key: str) -> str | None:
        if self._pending is not None:
            last = maps.collapse(self._pending.filter(F.col("k") == key), ["k"]).take(1)
            if last:
                return last[0]["v"] if last[0]["op"] == maps.INSERT else None
        return self.engine.lookup(self.root, key) if self.root else None

    def range(self, start: str | None = None, end: str | None = None, **kw) -> DataFrame:
        base = self.engine.items(self.root, start, end) if self.root else self.engine.spark.createDataFrame([], ITEMS)
        rows = base if self._pending is None else maps.overlay(base, self._pending, ["k"])
        return maps.scan(rows, "k", start, end, ordered=True, **kw)

    def clear(self) -> None:
        self._pending = None

    def stage(self) -> str:
        """Write the pending changes as a version that this handle then reads; returns its root."""
        if self._pending is None:
            raise NoChangesToWrite(self.name)
        if self.detached:
            raise DetachedHead(self.name)
        changes = maps.collapse(self._pending, ["k"]).select("k", "op", "v")
        self._keep_stage(self.engine.change_tree(self.staged or self.tip, changes))
        self._pending = None
        return self.staged

    def commit(self, message: str | None = None) -> str:
        """Publish the staged version; the same content as the tip adds nothing."""
        if self.detached:
            raise DetachedHead(self.name)
        if self.staged is None:
            raise CommitEmptyStage(self.name)
        if self.staged == self.tip:
            self._keep_stage(None)
            return self.tip
        engine = self.engine
        if engine.head(self.rid) != self.start:
            raise InUse(f"{engine.remote}/{self.rid} moved since it was opened")
        last = engine.entry(self.start)
        n, tips = (last["n"] + 1, dict(last["tips"])) if last else (0, {})
        tips[self.name] = self.staged
        row = engine.spark.createDataFrame([(self.start, engine.remote, self.rid, self.name, self.staged, message, int(engine.clock()), n, tips)], LOG.removeprefix("addr string, "))
        entry = row.withColumn("addr", F.concat(F.lit(f"{self.rid}:{n:012d}:"), content_id(F.concat_ws("|", F.coalesce("prev", F.lit("")), "repo", "tip"))))
        address = entry.first()["addr"]
        entry.select(*[x.split()[0] for x in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(f"{engine.path}/log")
        engine.meta.set_head(engine.remote, self.rid, address, expected=self.start)
        self.tip, self.start = self.staged, address
        self._keep_stage(None)
        return self.tip

    def history(self) -> DataFrame:
        return self.engine.live(self.rid).filter(F.col("repo") == self.name).dropDuplicates(["addr"]).orderBy(F.desc("n"))

    def diff(self, old: str, new: str) -> DataFrame:
        """What changed between two versions. Items of leaves that both have are not compared."""
        a, b = self.engine.leaves(old), self.engine.leaves(new)
        only = lambda x, y: x.join(y.select("addr"), "addr", "left_anti").select(F.explode("items").alias("i")).select("i.k", "i.v")
        return maps.diff(only(a, b), only(b, a), ["k"])

    def write_bytes(self, path: str, data: bytes, sizes: tuple[int, int, int] = (MIN_SIZE, MEAN_SIZE, MAX_SIZE)) -> None:
        """Put a byte string under a path, in chunks; it is staged and committed as any value."""
        if not path:
            raise CannotReplaceRootMap("the root map cannot be replaced")
        spark = self.engine.spark
        parts = self.engine.put_bytes(spark.createDataFrame([(0, bytearray(data))], "key bigint, data binary"), "key", "data", sizes)
        self.insert(path, "bytes:" + self.engine.save("bytes", parts.select(F.lpad(F.col("pos").cast("string"), 10, "0").alias("k"), F.col("cid").alias("v"))))

    def read_bytes(self, path: str) -> bytes | None:
        """The byte string under a path; WrongType if a plain value is there."""
        value = self.get(path)
        if value is None:
            return None
        if not value.startswith("bytes:"):
            raise WrongType(f"{path} is no byte string")
        parts = self.engine.load(value.removeprefix("bytes:"), "bytes").select(F.lit(0).cast("bigint").alias("key"), F.col("k").cast("int").alias("pos"), F.col("v").alias("cid"))
        return bytes(self.engine.get_bytes(parts).first()["bytes"])
