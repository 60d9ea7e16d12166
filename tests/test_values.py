from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakecairn.errors import InvalidInput, InvalidLength
from lakecairn.functions import hashing, rolling, values


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_base58_round_trip(data):
    assert hashing.unbase58(hashing.base58(data)) == data


def test_base58_refuses():
    for bad in ("", "abc", "z0", "zO", "zé"):
        with pytest.raises(InvalidInput):
            hashing.unbase58(bad)
    with pytest.raises(InvalidLength):
        hashing.unbase58(hashing.base58(b"abc"), 36)


def test_ids_on_frames(spark):
    df = spark.createDataFrame([(bytearray(b"foo"), "zbad0"), (None, None)], "b binary, t string")
    rows = df.select(hashing.content_id_blake2b("b").alias("c"), hashing.encode_base58("b").alias("e"), hashing.decode_base58("t").alias("d"), hashing.int_id(F.lit(258), 6).alias("i"), hashing.lfs_pointer(F.col("b")).alias("p")).collect()
    assert bytes(rows[0].c) == hashing.blake2b_cid(b"foo") and len(rows[0].c) == hashing.CID_SIZE
    assert rows[0].e == hashing.base58(b"foo") and rows[0].d is None and rows[1].e is None
    assert bytes(rows[0].i) == bytes([0, 0, 1, 2, 0, 0]) and rows[0].p.oid.startswith("sha256:2c26b46b68ff") and rows[0].p.size == 3


TABLE = [("foo", 2, "foo"), ("5", 1, 5), ("505", 1, 505), ("str:foo", 2, "foo"), ("u32:5", 1, 5), ("U32:7", 1, 7), ("foo/bar", 2, "foo/bar"), ("addr:" + "ab" * 32, 0, bytes.fromhex("ab" * 32)), ("99999999999", 2, "99999999999"), ("", 2, "")]


def test_parse_scalars(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TABLE] + [("u32:x",), ("addr:12",)], "t string").withColumn("s", values.parse_scalar(F.col("t")))
    got = {r.t: r.s for r in df.collect()}
    for t, tag, want in TABLE:
        s = got[t]
        assert s.tag == tag and {0: s.addr and bytes(s.addr), 1: s.u32, 2: s.str}[tag] == want
        assert values.scalar_of(t) == want
    assert got["u32:x"] is None and got["addr:12"] is None
    for bad in ("u32:x", "u32:4294967296", "addr:12"):
        with pytest.raises(InvalidInput):
            values.scalar_of(bad)


def test_parse_paths(spark):
    table = [("5", ["5"]), ("5/foo", ["5", "foo"]), ("foo\\/bar", ["foo/bar"]), ("5\\/foo", ["5/foo"]), ("5/foo/bar\\/", ["5", "foo", "bar/"]), ("", [])]
    df = spark.createDataFrame([(t,) for t, _ in table], "t string").withColumn("p", values.parse_path(F.col("t")))
    assert {r.t: r.p for r in df.collect()} == dict(table)
    assert values.path_of("5/foo/bar\\/") == [5, "foo", "bar/"] and values.path_of("") == []


def test_order_and_text_of_values(spark):
    df = spark.range(1).select(F.explode(F.array(values.text(F.lit("b")), values.u32(F.lit(10)), values.u32(F.lit(9)), values.addr(F.unhex(F.lit("ff"))), values.vec(F.array(values.u32(F.lit(1), values.SCALAR_TYPE), values.text(F.lit("x,y"), values.SCALAR_TYPE))))).alias("v"))
    rows = df.orderBy("v").select(values.display(F.col("v")).alias("d"), values.encode(F.col("v")).alias("e"), values.as_addr(F.col("v")).alias("a")).collect()
    assert [r.d for r in rows] == ["ff", "9", "10", "b", "1,x,y"]
    assert [r.e for r in rows] == ["aff", "u9", "u10", "sb", "vu1,sx\\,y"]
    assert [r.a is not None for r in rows] == [True, False, False, False, False]
    with pytest.raises(Exception, match="unsigned 32-bit"):
        spark.range(1).select(values.u32(F.lit(1 << 32))).collect()


@pytest.mark.parametrize("window", [1, 31, 32, 64, 67])
def test_rolling_hash_equals_byte_by_byte(spark, window):
    texts = ["", "a", "hello rolling world " * 20, "é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in rolling.roll_frame(df, "id", "t", window).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.h)
    whole = {r.id: r.hashes for r in rolling.rolled(df, "id", "t", window).collect()}
    marks = rolling.boundaries(df, "id", "t", 3, window).collect()
    for i, t in enumerate(texts):
        want = rolling.roll(t.encode(), window)
        assert got.get(i, []) == whole[i] == want
        assert [(r.pos, r.h) for r in marks if r.id == i] == [(k, h) for k, h in enumerate(want) if h & 7 == 7]
