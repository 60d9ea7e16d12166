"""Content identifiers: native SHA-256 by default, others as Arrow functions."""

from __future__ import annotations

import hashlib
import secrets

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecairn.errors import InvalidInput, InvalidLength

#: The base-58 alphabet of multibase "z", and the multihash prefix of BLAKE2b-256 (code, length).
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BLAKE2B_256 = bytes.fromhex("a0e40220")

CID_SIZE = 36


def content_id(c: Column) -> Column:
    """Lower-case hex SHA-256 of text or bytes; equal to what SQL engines call sha256."""
    return F.sha2(c.cast("binary"), 256)


def blake2b_cid(data: bytes) -> bytes:
    """The 36 bytes of a BLAKE2b-256 multihash."""
    return BLAKE2B_256 + hashlib.blake2b(data, digest_size=32).digest()


@F.arrow_udf(T.BinaryType())
def content_id_blake2b(col: pa.Array) -> pa.Array:
    return pa.array([None if x is None else blake2b_cid(x) for x in col.cast(pa.binary()).to_pylist()], pa.binary())


def base58(data: bytes) -> str:
    """Multibase base58btc: "z" and the digits."""
    n = int.from_bytes(data, "big")
    out = ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return "z" + ALPHABET[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def unbase58(text: str, size: int | None = None) -> bytes:
    if not text.startswith("z") or any(c not in ALPHABET for c in text[1:]):
        raise InvalidInput(f"not base58btc: {text[:80]}")
    digits = text[1:]
    zeros = len(digits) - len(digits.lstrip(ALPHABET[0]))
    n = 0
    for c in digits:
        n = n * 58 + ALPHABET.index(c)
    data = b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")
    if size is not None and len(data) != size:
        raise InvalidLength(f"{len(data)} bytes, not {size}")
    return data


def _try_unbase58(text: str) -> bytes | None:
    try:
        return unbase58(text)
    except InvalidInput:
        return None


@F.arrow_udf(T.StringType())
def encode_base58(col: pa.Array) -> pa.Array:
    return pa.array([None if x is None else base58(x) for x in col.to_pylist()], pa.string())


@F.arrow_udf(T.BinaryType())
def decode_base58(col: pa.Array) -> pa.Array:
    """Bytes, or null for what is not base58btc."""
    return pa.array([None if x is None else _try_unbase58(x) for x in col.to_pylist()], pa.binary())


def base32hex(c: Column) -> Column:
    """Multibase base32hex in lower case, without padding: "v" and the digits. Text of it sorts as the bytes do."""
    digits = F.hex(c.cast("binary"))
    n = F.length(digits)
    whole = F.rpad(digits, F.ceil(n / 10).cast("int") * 10, "0")
    groups = F.transform(F.sequence(F.lit(0), F.ceil(n / 10).cast("int") - 1), lambda i: F.lpad(F.conv(whole.substr(i * 10 + 1, F.lit(10)), 16, 32), 8, "0"))
    text = F.when(n == 0, F.lit("")).otherwise(F.substring(F.lower(F.array_join(groups, "")), F.lit(1), F.ceil(n * 4 / 5).cast("int")))
    return F.concat(F.lit("v"), text)


def id_ok(c: Column, size: int = CID_SIZE) -> Column:
    """Whether bytes have the size of an id."""
    return F.octet_length(c) == size


def random_id(size: int = 8) -> bytes:
    """A replica id that nobody else has."""
    return secrets.token_bytes(size)


def int_id(c: Column, size: int) -> Column:
    """A number as an id: four big-endian bytes, filled with zeros on the right."""
    return F.unhex(F.rpad(F.lpad(F.hex(c.cast("bigint")), 8, "0"), 2 * size, "0"))


def replica_key(remote: Column, rid: Column) -> Column:
    return F.concat_ws("/", remote, rid)


def lfs_oid(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), content_id(c))


def lfs_pointer(c: Column) -> Column:
    """The fields of a large-file pointer: version, oid, size in bytes."""
    return F.struct(F.lit("1").alias("version"), lfs_oid(c).alias("oid"), F.octet_length(c).cast("bigint").alias("size"))
