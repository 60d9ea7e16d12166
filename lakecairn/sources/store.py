"""Stores: immutable blobs by content id, and mutable keys with the last write winning."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lakecairn.errors import InUse, NotFound
from lakecairn.functions.hashing import base32hex, content_id, lfs_pointer
from lakecairn.operators.chunking import MAX_SIZE, MEAN_SIZE, MIN_SIZE, assemble, chunks
from lakecairn.operators.listing import listing

BLOB = "cid string, bytes binary, shard string"
META = "key string, value binary, seq bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table's rows; a table that was never written has none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def missing(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct blobs of new that the store has not."""
    return new.dropDuplicates(["cid"]).join(stored.select("cid"), "cid", "left_anti")


class ContentStore:
    """Blobs as Parquet files in folders by the last two digits of their id, so a point read opens one folder.

    ``name`` makes the id of a blob as text: SHA-256 unless said otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, name: Callable[[Column], Column] = content_id):
        self.spark, self.path, self.name = spark, path, name

    def frame(self) -> DataFrame:
        return _read(self.spark, self.path, BLOB).select("cid", "bytes", "shard")

    def shard(self, cid: str) -> str:
        return cid[-2:]

    def _write(self, blobs: DataFrame) -> None:
        # Few files a folder, and more tasks for a folder that gets much.
        blobs.hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)

    def put(self, blobs: DataFrame, data: str = "bytes") -> DataFrame:
        """Write blobs that are not there yet; returns their ids. Writing again changes nothing."""
        new = blobs.select(F.col(data).cast("binary").alias("bytes")).filter("bytes is not null").withColumn("cid", self.name(F.col("bytes")))
        self._write(missing(new, self.frame()).withColumn("shard", F.substring("cid", -2, 2)))
        return new.select("cid").distinct()

    def exists(self, cids: DataFrame) -> DataFrame:
        """cids (cid) that are there."""
        return cids.join(self.frame().select("cid"), "cid", "left_semi")

    def get(self, cid: str) -> bytes:
        rows = self.frame().filter((F.col("shard") == self.shard(cid)) & (F.col("cid") == cid)).select("bytes").take(1)
        if not rows:
            raise NotFound(cid, self.path)
        return bytes(rows[0][0])

    def read(self, cids: DataFrame, strict: bool = False) -> DataFrame:
        """cids with their bytes; strict raises where one is missing."""
        found = cids.join(self.frame().select("cid", "bytes"), "cid", "left")
        if strict:
            gone = found.filter("bytes is null").select("cid").take(1)
            if gone:
                raise NotFound(gone[0][0], self.path)
            return found
        return found.filter("bytes is not null")


class MemoryStore(ContentStore):
    """A content store in the executors' memory (and disks), for as long as the session lasts."""

    def __init__(self, spark: SparkSession, name: Callable[[Column], Column] = content_id):
        super().__init__(spark, "memory", name)
        self._parts: list[DataFrame] = []

    def frame(self) -> DataFrame:
        out = self.spark.createDataFrame([], BLOB)
        for part in self._parts:
            out = out.unionByName(part)
        return out.select("cid", "bytes", "shard")

    def _write(self, blobs: DataFrame) -> None:
        kept = blobs.select("cid", "bytes", "shard").persist()
        kept.count()
        self._parts.append(kept)


class CachedStore:
    """A store with blobs that were read or written lately at hand on the driver, up to a number of bytes."""

    def __init__(self, store: ContentStore, most: int = 1 << 20):
        self.store, self.most, self.size, self.hits = store, most, 0, 0
        self._held: OrderedDict[str, bytes] = OrderedDict()

    def get(self, cid: str) -> bytes:
        if cid in self._held:
            self.hits += 1
            self._held.move_to_end(cid)
            return self._held[cid]
        data = self.store.get(cid)
        self._hold(cid, data)
        return data

    def _hold(self, cid: str, data: bytes) -> None:
        if len(data) > self.most or cid in self._held:
            return
        self._held[cid] = data
        self.size += len(data)
        while self.size > self.most:
            self.size -= len(self._held.popitem(last=False)[1])

    def put_one(self, data: bytes) -> str:
        """Write one blob; one that is held is there already and is not written again."""
        spark = self.store.spark
        cid = spark.createDataFrame([(bytearray(data),)], "bytes binary").select(self.store.name(F.col("bytes")).alias("cid")).first()["cid"]
        if cid not in self._held:
            self.store.put(spark.createDataFrame([(bytearray(data),)], "bytes binary"))
            self._hold(cid, data)
        return cid

    def put(self, blobs: DataFrame, data: str = "bytes") -> DataFrame:
        return self.store.put(blobs, data)

    def read(self, cids: DataFrame, strict: bool = False) -> DataFrame:
        return self.store.read(cids, strict)


class Codec(Protocol):
    """Rows to bytes and back."""

    def encode(self, row: Column) -> Column: ...

    def decode(self, data: Column, schema: str) -> Column: ...


class JsonCodec:
    def encode(self, row: Column) -> Column:
        return F.to_json(row, {"ignoreNullFields": "false"}).cast("binary")

    def decode(self, data: Column, schema: str) -> Column:
        return F.from_json(data.cast("string"), schema, {"mode": "FAILFAST"})


class DelimitedCodec:
    """Fields by commas, for flat rows; a null field is empty and unquoted."""

    def encode(self, row: Column) -> Column:
        return F.to_csv(row, {"emptyValue": '""', "nullValue": ""}).cast("binary")

    def decode(self, data: Column, schema: str) -> Column:
        return F.from_csv(data.cast("string"), schema, {"mode": "FAILFAST", "emptyValue": "", "nullValue": ""})


class RecordStore:
    """Rows as blobs: each row's text, JSON unless another codec is given, is stored by its content id."""

    def __init__(self, blobs: ContentStore, codec: Codec | None = None):
        self.blobs, self.codec = blobs, codec or JsonCodec()

    def put(self, rows: DataFrame) -> DataFrame:
        """rows with their cid."""
        named = rows.withColumn("bytes", self.codec.encode(F.struct(*rows.columns)))
        self.blobs.put(named.select("bytes"))
        return named.withColumn("cid", self.blobs.name(F.col("bytes"))).drop("bytes")

    def read(self, cids: DataFrame, schema: str) -> DataFrame:
        """cids with the fields of their rows; text of another form raises."""
        found = self.blobs.read(cids).withColumn("_row", self.codec.decode(F.col("bytes"), schema))
        return found.select(*[c for c in cids.columns], "_row.*")


class LargeFileStore:
    """Byte strings behind pointers (version, oid, size): oid is ``sha256:`` and the digest, bytes are kept in chunks."""

    INDEX = "oid string, pos int, cid string"

    def __init__(self, blobs: ContentStore, path: str):
        self.blobs, self.path = blobs, path

    def write(self, data: DataFrame, key: str, col: str, sizes: tuple[int, int, int] = (MIN_SIZE, MEAN_SIZE, MAX_SIZE)) -> DataFrame:
        """Store byte strings; returns key with its pointer."""
        cut = chunks(data, key, col, *sizes)
        self.blobs.put(cut)
        pointers = data.select(F.col(key).cast("bigint").alias("key"), lfs_pointer(F.col(col).cast("binary")).alias("pointer"))
        named = cut.join(pointers, "key").select("pointer.oid", "pos", "cid").distinct()
        named.join(self._index().select("oid").distinct(), "oid", "left_anti").write.mode("append").parquet(self.path)
        return pointers

    def _index(self) -> DataFrame:
        return _read(self.blobs.spark, self.path, self.INDEX)

    def pieces(self, oid: str):
        """The chunks of one oid in order, one after the other, so that a large file is never held whole."""
        parts = self._index().filter(F.col("oid") == oid).join(self.blobs.frame().select("cid", "bytes"), "cid").orderBy("pos").select("bytes")
        none = True
        for row in parts.toLocalIterator():
            none = False
            yield bytes(row[0])
        if none:
            raise NotFound(oid, self.path)

    def read(self, oid: str) -> bytes:
        """The bytes of one oid: pointer to index to chunks."""
        return b"".join(self.pieces(oid))

    def read_all(self, oids: DataFrame) -> DataFrame:
        """oids (oid) with their bytes."""
        named = oids.join(self._index(), "oid").withColumn("key", F.xxhash64("oid"))
        back = assemble(named.select("key", "pos", "cid"), self.blobs.frame().select("cid", "bytes"))
        return back.join(named.select("key", "oid").distinct(), "key").select("oid", "bytes")

    #: The text form of a pointer.
    TEXT = "version {}\noid {}\nsize {}\n"

    def clean(self, data: DataFrame, key: str, col: str, **kw) -> DataFrame:
        """What a clean filter writes into a repository: the bytes are stored, their pointer's text stays."""
        p = self.write(data, key, col, **kw)
        text = F.concat(F.lit("version "), F.col("pointer.version"), F.lit("\noid "), F.col("pointer.oid"), F.lit("\nsize "), F.col("pointer.size").cast("string"), F.lit("\n"))
        return p.select("key", text.alias("text"))

    def smudge(self, pointers: DataFrame) -> DataFrame:
        """The bytes behind pointer texts (key, text), as a smudge filter gives them; other text stays as it is."""
        oid = F.nullif(F.regexp_extract("text", r"\Aversion [^\n]+\noid (sha256:[0-9a-f]{64})\nsize [0-9]+\n\z", 1), F.lit(""))
        named = pointers.withColumn("oid", oid)
        back = self.read_all(named.filter("oid is not null").select("oid").distinct())
        return named.join(back, "oid", "left").select("key", F.coalesce("bytes", F.when(F.col("oid").isNull(), F.col("text").cast("binary"))).alias("bytes"))


class Claims:
    """Names that only one can take: files of a shared folder that are made only if they are not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def take(self, name: str) -> bool:
        fs, where = self._at(name)
        try:
            fs.create(where, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
                return False
            raise
        return True

    def age(self, name: str) -> float:
        """Seconds since a name was taken."""
        fs, where = self._at(name)
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000


class MetaStore:
    """String keys to bytes. A write appends under a number of its own; a read takes the last one."""

    def __init__(self, spark: SparkSession, path: str, lease: float = 600.0):
        self.spark, self.path, self.lease = spark, path, lease
        self.claims = Claims(spark, f"{path}-claims")

    def log(self) -> DataFrame:
        return _read(self.spark, self.path, META)

    def frame(self) -> DataFrame:
        return self.log().groupBy("key").agg(F.max_by("value", "seq").alias("value"))

    def next_seq(self) -> int:
        return (self.log().agg(F.max("seq")).first()[0] or 0) + 1

    def _append(self, key: str, value: bytes) -> None:
        seq = self.next_seq()
        while not self.claims.take(f"seq/{seq}"):  # two writers never share a number
            seq += 1
        self.spark.createDataFrame([(key, bytearray(value), seq)], META).coalesce(1).write.mode("append").parquet(self.path)

    def put(self, key: str, value: bytes) -> None:
        self._append(key, value)

    def put_all(self, rows: DataFrame) -> None:
        """Rows (key, value, seq) at once; seq orders the writes of a key among themselves, after all before."""
        start = self.next_seq() - 1
        rows.select("key", F.col("value").cast("binary").alias("value"), (F.col("seq") + start).cast("bigint").alias("seq")).write.mode("append").parquet(self.path)

    def swap(self, key: str, expected: bytes | None, value: bytes) -> None:
        """Put a value if the key still has the one that is expected; of several at once only one goes through, the others raise InUse.

        The right to the key's next version is a claim; one whose owner died before writing is void after ``lease`` seconds.
        """
        rows = self.log().filter(F.col("key") == key).agg(F.count("*").alias("n"), F.max_by("value", "seq").alias("value")).first()
        now = None if rows["value"] is None else bytes(rows["value"])
        if now != expected:
            raise InUse(f"{key} moved")
        name = self.spark.range(1).select(base32hex(F.lit(key))).first()[0]
        version, tries = rows["n"] + 1, 0
        while not self.claims.take(f"swap/{name}/{version}.{tries}"):
            if self.claims.age(f"swap/{name}/{version}.{tries}") < self.lease:
                raise InUse(f"{key} is being written")
            tries += 1
        self._append(key, value)

    def get(self, key: str) -> bytes:
        rows = self.log().filter(F.col("key") == key).agg(F.max_by("value", "seq").alias("value")).filter("value is not null").take(1)
        if not rows:
            raise NotFound(key, self.path)
        return bytes(rows[0][0])

    def list(self, prefix: str = "", delimiter: str | None = None) -> list[str]:
        """Keys in order, as an object store lists them."""
        return [r.key for r in listing(self.log().select("key"), "key", prefix, delimiter).orderBy("key").toLocalIterator()]

    def head(self, remote: str, rid: str) -> str:
        return self.get(f"{remote}/{rid}").decode()

    def set_head(self, remote: str, rid: str, cid: str, expected: str | None = "") -> None:
        """The head of a replica; with ``expected`` (None: no head yet) only if it is still that one, else InUse."""
        if expected == "":
            self.put(f"{remote}/{rid}", cid.encode())
        else:
            self.swap(f"{remote}/{rid}", None if expected is None else expected.encode(), cid.encode())

    def replicas(self, remote: str) -> list[str]:
        return [k.removeprefix(f"{remote}/") for k in self.list(f"{remote}/")]

    def heads(self, remote: str, rids: DataFrame, strict: bool = True) -> DataFrame:
        """rids (rid) with their head; strict raises on the first that has none."""
        found = heads_of(self.frame().select("key", F.col("value").cast("string").alias("head")), F.lit(remote), rids)
        if strict:
            gone = found.filter("head is null").select("rid").take(1)
            if gone:
                raise NotFound(f"{remote}/{gone[0][0]}", self.path)
        return found


def heads_of(meta: DataFrame, remote: Column, rids: DataFrame) -> DataFrame:
    """rids with the head that meta (key, head) has under remote/rid, null where it has none."""
    return rids.withColumn("key", F.concat_ws("/", remote, F.col("rid").cast("string"))).join(meta, "key", "left").select("rid", "head")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as blobs: path, size, bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("content").alias("bytes"))
