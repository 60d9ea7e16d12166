from __future__ import annotations

import io
import sys

import pytest
from pyspark.sql import functions as F

from lakecairn.__main__ import main
from lakecairn.errors import CannotReplaceRootMap, CommitEmptyStage, DanglingAddress, DetachedHead, InUse, NoChangesToWrite, NotFound, NotModified, UndiffableType, UnmergeableType, WrongType
from lakecairn.functions.values import key_text
from lakecairn.plans.containers import KINDS, Container, ContainerRepo, describe
from lakecairn.plans.engine import Engine
from lakecairn.config import Config
from lakecairn.functions import head
from lakecairn.functions.hashing import base32hex
from lakecairn.sources.store import CachedStore, ContentStore, LargeFileStore, MemoryStore, MetaStore, RecordStore, import_files
from lakecairn.streaming import ingest


def test_content_store(spark, tmp_path):
    store = ContentStore(spark, f"{tmp_path}/blobs")
    df = spark.createDataFrame([(bytearray(b"foo"),), (bytearray(b"bar"),), (bytearray(b"foo"),), (None,)], "bytes binary")
    ids = store.put(df)
    assert ids.count() == 2 and store.put(df).count() == 2 and store.frame().count() == 2
    cid = "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"
    assert store.get(cid) == b"foo"
    with pytest.raises(NotFound):
        store.get("00" * 32)
    asked = spark.createDataFrame([(cid,), ("00" * 32,)], "cid string")
    assert store.exists(asked).count() == 1 and store.read(asked).count() == 1
    with pytest.raises(NotFound):
        store.read(asked, strict=True)


def test_meta_store(spark, tmp_path):
    meta = MetaStore(spark, f"{tmp_path}/meta")
    with pytest.raises(NotFound):
        meta.get("x")
    for k, v in (("local/b", b"1"), ("local/a", b"2"), ("local/b", b"3"), ("other/c", b"4")):
        meta.put(k, v)
    assert meta.get("local/b") == b"3" and meta.list("local/") == ["local/a", "local/b"] and meta.list("", "/") == ["local/", "other/"]
    assert meta.replicas("local") == ["a", "b"] and meta.head("local", "b") == "3"
    rids = spark.createDataFrame([("a",), ("z",)], "rid string")
    assert {r.rid: r.head for r in meta.heads("local", rids, strict=False).collect()} == {"a": "2", "z": None}
    with pytest.raises(NotFound):
        meta.heads("local", rids)


def test_commit_cycle(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo", clock=lambda: 7)
    repo = engine.repo("foo")
    with pytest.raises(NoChangesToWrite):
        repo.stage()
    with pytest.raises(CommitEmptyStage):
        repo.commit()
    repo.insert("k", "foo")
    other = engine.repo("foo")
    assert repo.get("k") == "foo" and other.get("k") is None  # pending is this handle's alone
    foo = repo.stage()
    assert repo.commit() == foo and Engine.open(spark, f"{tmp_path}/repo").repo("foo").get("k") == "foo"
    repo.insert("k", "bar")
    repo.remove("gone")
    bar = repo.stage()
    repo.commit()
    repo.insert("k", "foo")
    assert repo.stage() == foo != bar and repo.commit() == foo  # same content, same address
    n = engine.log().count()
    repo.insert("k", "foo")
    repo.stage()
    assert repo.commit() == foo and engine.log().count() == n == 3  # nothing new
    assert [r.tip for r in repo.history().collect()] == [foo, bar, foo]
    d = repo.diff(foo, bar).collect()
    assert [(r.k, r.change, r.old_v, r.new_v) for r in d] == [("k", "changed", "foo", "bar")]
    assert engine.repo("unknown").get("k") is None and engine.repo("foo", "elsewhere").get("k") is None


def test_two_writers(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    a, b = engine.repo("r"), engine.repo("r")
    a.insert("x", "1")
    a.stage()
    b.insert("y", "2")
    b.stage()
    a.commit()
    with pytest.raises(InUse):
        b.commit()
    with pytest.raises(NotFound):
        Engine.open(spark, f"{tmp_path}/nowhere")


def test_a_commit_that_breaks_off_and_a_clock_that_steps_back(spark, tmp_path, monkeypatch):
    times = iter([9, 8, 7, 6])
    engine = Engine.init(spark, f"{tmp_path}/repo", clock=lambda: next(times))
    repo = engine.repo("r")
    repo.insert("k", "first")
    repo.stage()
    first = repo.commit()
    repo.insert("k", "second")
    repo.stage()
    second = repo.commit("later, by an earlier clock")
    assert engine.repo("r").tip == second != first
    repo.insert("k", "third")
    third = repo.stage()

    def dies(*a, **kw):
        raise RuntimeError("no power")

    with monkeypatch.context() as m:
        m.setattr(engine.meta, "set_head", dies)
        with pytest.raises(RuntimeError):
            repo.commit()
    again = Engine.open(spark, f"{tmp_path}/repo", clock=lambda: 1).repo("r")
    assert again.tip == second and engine.log().count() == 3 and [r.tip for r in again.history().collect()] == [second, first]
    assert again.staged == third and again.commit() == third
    assert [r.tip for r in again.history().collect()] == [third, second, first]
    assert engine.repo("other").tip is None and [r.message for r in again.history().collect()] == [None, "later, by an earlier clock", None]


def test_heads_are_swapped_once(spark, tmp_path):
    meta = MetaStore(spark, f"{tmp_path}/meta", lease=600)
    meta.set_head("local", "a", "1", expected=None)
    with pytest.raises(InUse):
        meta.set_head("local", "a", "2", expected=None)
    name = spark.range(1).select(base32hex(F.lit("local/a"))).first()[0]
    assert meta.claims.take(f"swap/{name}/2.0")  # a writer that dies before it writes
    with pytest.raises(InUse):
        meta.set_head("local", "a", "2", expected="1")
    late = MetaStore(spark, f"{tmp_path}/meta", lease=-1)
    late.set_head("local", "a", "2", expected="1")
    assert meta.head("local", "a") == "2" and not meta.claims.take(f"swap/{name}/2.1")
    assert meta.claims.take(f"seq/{meta.next_seq()}")  # a number that someone else has just taken
    meta.put("k", b"v")
    assert meta.get("k") == b"v" and meta.log().select("seq").distinct().count() == meta.log().count()


def test_point_reads_open_one_node_a_level(spark, tmp_path, monkeypatch):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    repo = engine.repo("r")
    repo.change(spark.range(600).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k"), F.lit("insert").alias("op"), F.col("id").cast("string").alias("v")))
    repo.stage()
    repo.commit()
    opened = []
    node = engine.node
    monkeypatch.setattr(engine, "node", lambda addr: opened.append(addr) or node(addr))
    top = node(repo.root)
    assert repo.get("0123") == "123" and len(opened) == top["level"] + 1 >= 3
    assert repo.get("x") is None and repo.get("") is None
    assert engine.leaves(repo.root, "0100", "0110").count() < engine.leaves(repo.root).count() / 4
    files = engine.nodes().count()
    repo.insert("0300", "new")
    repo.stage()
    assert engine.nodes().count() - files <= 2 * (top["level"] + 2)  # only what changed is written
    with pytest.raises(DanglingAddress):
        engine.leaves("00" * 32)


def test_status_and_detached_versions(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    repo = engine.repo("r")
    assert repo.status() == {"status": "init", "commit": None, "staged": None, "content": None}
    repo.insert("k", "1")
    one = repo.stage()
    assert repo.status() == {"status": "init_staged", "commit": None, "staged": one, "content": one}
    repo.commit()
    repo.insert("k", "2")
    two = repo.stage()
    assert repo.status()["status"] == "staged" and engine.repo("r").staged == two
    repo.commit()
    assert repo.status()["status"] == "clean"
    repo.checkout(one)
    assert repo.get("k") == "1" and repo.status()["status"] == "detached"
    repo.insert("k", "3")
    for act in (repo.stage, repo.commit):
        with pytest.raises(DetachedHead):
            act()
    repo.checkout(None)
    repo.clear()
    assert repo.get("k") == "2"


def test_bytes_under_a_path(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    repo = engine.repo("r")
    data = bytes(range(256)) * 40
    repo.write_bytes("docs/a", data, (256, 512, 1024))
    repo.insert("plain", "x")
    repo.stage()
    repo.commit()
    again = engine.repo("r")
    assert again.read_bytes("docs/a") == data and again.read_bytes("docs/b") is None
    with pytest.raises(WrongType):
        again.read_bytes("plain")
    with pytest.raises(CannotReplaceRootMap):
        repo.write_bytes("", b"")


def test_containers(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    rows = lambda *xs: spark.createDataFrame(list(xs), "rid string, n long")
    one = Container(engine, "g-counter")
    assert one.dirty and one.value() == 0 and describe(one.kind) == {"name": "g-counter", "params": []}
    one.add(rows(("a", 1)))
    two = Container(engine, "g-counter")
    two.add(rows(("a", 1), ("b", 2)))
    cid = two.save()
    assert not two.dirty and two.save() == cid and Container(engine, "g-counter", cid).value() == 3
    one.merge(cid)
    one.merge(cid)
    assert one.value() == 3 and one.diff(cid).isEmpty() and one.save() == cid  # equal content, equal id
    assert two.get("b") == "2" and two.save_with_cids()[1][-1] == cid
    with pytest.raises(WrongType):
        Container(engine, "set", cid)
    with pytest.raises(DanglingAddress):
        Container(engine, "set", "00" * 32)
    words = Container(engine, "text")
    assert words.value() == ""
    words.add(spark.createDataFrame([("foo",)], "value string"))
    foo = words.save()
    with pytest.raises(UnmergeableType):
        words.merge(foo)
    with pytest.raises(UndiffableType):
        words.diff(foo)
    m = Container(engine, "map")
    keys = [10, 9, "9", "", b"\x01" * 32, 4294967295]
    m.add(spark.createDataFrame([(key_text(k), "insert", str(i)) for i, k in enumerate(keys)], "k string, op string, v string"))
    m.save()
    assert m.keys() == [b"\x01" * 32, 9, 10, 4294967295, "", "9"] and m.get(10) == "0" and m.get("9") == "2" and m.get(8) is None
    repo = ContainerRepo(engine, "title", "text")
    for t in ("foo", "bar", "foo"):
        repo.add(spark.createDataFrame([(t,)], "value string"))
        repo.commit()
    assert ContainerRepo(engine, "title", "text").value() == "foo" and repo.history().count() == 3
    with pytest.raises(NotModified):
        repo.stage()
    assert repo.commit() == repo.tip and repo.history().count() == 3
    with pytest.raises(WrongType):
        ContainerRepo(engine, "title", "set")
    with pytest.raises(NotFound):
        repo.merge_replica("nobody")
    assert set(KINDS) >= {"g-counter", "pn-counter", "set", "list", "text", "map", "max-register"}


def test_stores_in_memory_and_with_a_cache(spark, tmp_path):
    store = MemoryStore(spark)
    df = spark.createDataFrame([(bytearray(b"foo"),), (bytearray(b"bar"),), (bytearray(b"foo"),)], "bytes binary")
    assert store.put(df).count() == 2 and store.put(df).count() == 2 and store.frame().count() == 2
    cached = CachedStore(ContentStore(spark, f"{tmp_path}/blobs"), most=6)
    a, b = cached.put_one(b"aaa"), cached.put_one(b"bbb")
    assert cached.get(a) == b"aaa" and cached.hits == 1 and cached.put_one(b"aaa") == a
    c = cached.put_one(b"ccc")
    assert cached.size == 6 and cached.get(b) == b"bbb" and cached.get(c) == b"ccc" and cached.hits == 2
    with pytest.raises(NotFound):
        cached.get("00" * 32)


def test_ranges_on_a_version(spark, tmp_path):
    repo = Engine.init(spark, f"{tmp_path}/repo").repo("r")
    repo.change(spark.range(300).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k"), F.lit("insert").alias("op"), F.col("id").cast("string").alias("v")))
    repo.stage()
    repo.remove("0005")
    repo.insert("0006", "six")
    assert [(r.k, r.v) for r in repo.range("0004", "0008").collect()] == [("0004", "4"), ("0006", "six"), ("0007", "7")]
    repo.clear()
    assert [r.k for r in repo.range("0004", "0006", end_closed=True).collect()] == ["0004", "0005", "0006"]


def test_bytes_and_files(spark, tmp_path):
    engine = Engine.init(spark, f"{tmp_path}/repo")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"hello " * 3000)
    files = import_files(spark, f"{tmp_path}/f").select(F.lit(1).cast("bigint").alias("id"), "bytes")
    idx = engine.put_bytes(files, "id", "bytes", (256, 512, 1024))
    assert bytes(engine.get_bytes(idx).first().bytes) == b"hello " * 3000


def test_records_and_large_files(spark, tmp_path):
    blobs = ContentStore(spark, f"{tmp_path}/blobs")
    records = RecordStore(blobs)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    cids = records.put(rows).select("cid").distinct()
    assert sorted((r.i, r.s) for r in records.read(cids, "i int, s string").collect()) == [(1, "a"), (2, None)]
    files = LargeFileStore(blobs, f"{tmp_path}/lfs")
    data = spark.createDataFrame([(1, bytearray(b"foo")), (2, bytearray(b"x" * 5000)), (3, bytearray(b""))], "id long, b binary")
    pointers = {r.key: r.pointer for r in files.write(data, "id", "b", (256, 512, 1024)).collect()}
    assert files.read(pointers[1].oid) == b"foo" and files.read(pointers[2].oid) == b"x" * 5000 and files.read(pointers[3].oid) == b""
    files.write(data, "id", "b", (256, 512, 1024))
    assert files.read(pointers[2].oid) == b"x" * 5000 and pointers[2].size == 5000
    with pytest.raises(NotFound):
        files.read("sha256:00")


def test_config(tmp_path):
    (tmp_path / ".lakecairn").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    assert Config().locate(tmp_path / "a/b") == tmp_path / ".lakecairn" and Config().name == "default"
    assert Config(workspace="w").merge(Config(base=tmp_path, folder="x")).locate() == tmp_path / "x"
    with pytest.raises(NotFound):
        Config(folder=".no-such-folder").locate(tmp_path)


def test_head_text(spark):
    rows = [("main", None, None), ("main", "aa", None), (None, None, "bb")]
    df = spark.createDataFrame(rows, "branch string, staged string, detached string")
    text = df.select(head.to_text(F.col("branch"), F.col("staged"), F.col("detached")).alias("t"))
    assert {r.t for r in text.collect()} == {"branch: main", "branch: main\nstaged_content: aa", "detached: bb"}
    assert sorted(map(str, text.select(head.from_text(F.col("t")).alias("h")).select("h.*").collect())) == sorted(map(str, df.collect()))
    for bad in ("nothing", "branch: a\nother: b", "detached: "):
        with pytest.raises(Exception, match="unknown head"):
            spark.createDataFrame([(bad,)], "t string").select(head.from_text(F.col("t")).alias("h")).collect()


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, seq long, v string").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k string, seq long, v string").parquet(f"{tmp_path}/in")
    engine = Engine.init(spark, f"{tmp_path}/repo")
    repo = engine.repo("s")
    ingest.start(stream(), ingest.upsert_sink(repo, "k", "v", "seq"), f"{tmp_path}/c1").awaitTermination()
    assert {r.k: r.v for r in repo.read().collect()} == {"a": "z", "b": "y"}
    ingest.start(stream(), ingest.upsert_sink(repo, "k", "v", "seq"), f"{tmp_path}/c2").awaitTermination()  # a replay
    assert engine.log().count() == 1
    ingest.start(stream(), ingest.blob_sink(engine.blobs, "v"), f"{tmp_path}/c3").awaitTermination()
    assert engine.blobs.frame().count() == 3
    q = ingest.counts(stream(), "k", "seq").writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").count() == 3
    timed = stream().withColumn("ts", F.timestamp_seconds("seq"))
    q = ingest.windowed(timed, "ts", "k").writeStream.outputMode("update").format("memory").queryName("timed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: r.n for r in spark.table("timed").collect()} == {"a": 2, "b": 1}


def test_last_writes_with_state(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "key string, seq long, value string").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, seq long, value string").parquet(f"{tmp_path}/in")
        q = ingest.last_writes(stream).writeStream.outputMode("update").format("memory").queryName("last").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {r.key: r.value for r in spark.table("last").collect()} == {"a": "z", "b": "y"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = f"{tmp_path}/cli"
    run = lambda *a: main([path, *a], spark)
    assert run("init") == 0
    assert run("map", "get", "k") == 1
    assert run("map", "put", "k", "v") == 0 and run("map", "put", "-c", "l", "w") == 0
    capsys.readouterr()
    assert run("map", "get", "k") == 0 and capsys.readouterr().out == "v\n"
    assert run("map", "ls", "-s", "l") == 0 and capsys.readouterr().out == "l w\n"
    (tmp_path / "b").write_bytes(b"some bytes")
    assert run("bytes", "put", f"{tmp_path}/b") == 0
    cid = capsys.readouterr().out.strip()
    out = io.TextIOWrapper(io.BytesIO())
    monkeypatch.setattr(sys, "stdout", out)
    assert run("bytes", "get", cid) == 0 and out.buffer.getvalue() == b"some bytes"
