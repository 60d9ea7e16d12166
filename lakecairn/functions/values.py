"""Tagged values: an address, an unsigned 32-bit number, a string, or a list of those.

Order goes by tag first, then by payload, as the order of the struct's fields says.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakecairn.errors import InvalidInput

ADDR, U32, STR, VEC = 0, 1, 2, 3
MAX_U32 = (1 << 32) - 1

SCALAR_TYPE = "struct<tag: tinyint, addr: binary, u32: bigint, str: string>"
VALUE_TYPE = f"struct<tag: tinyint, addr: binary, u32: bigint, str: string, vec: array<{SCALAR_TYPE}>>"


def _struct(tag: int, kind: str, addr=None, u32=None, text=None, vec=None) -> Column:
    fields = [F.lit(tag).alias("tag"), (addr if addr is not None else F.lit(None)).alias("addr"), (u32 if u32 is not None else F.lit(None)).alias("u32"), (text if text is not None else F.lit(None)).alias("str")]
    if kind is VALUE_TYPE:
        fields.append((vec if vec is not None else F.lit(None)).alias("vec"))
    return F.struct(*fields).cast(kind)


def u32_ok(c: Column) -> Column:
    return c.cast("bigint").between(0, MAX_U32)


def addr(c: Column, kind: str = VALUE_TYPE) -> Column:
    return _struct(ADDR, kind, addr=c)


def u32(c: Column, kind: str = VALUE_TYPE) -> Column:
    """A number; one out of range raises."""
    checked = F.when(c.isNull() | u32_ok(c), c.cast("bigint")).otherwise(F.raise_error(F.lit("not an unsigned 32-bit number")).cast("bigint"))
    return _struct(U32, kind, u32=checked)


def text(c: Column, kind: str = VALUE_TYPE) -> Column:
    return _struct(STR, kind, text=c.cast("string"))


def vec(scalars: Column) -> Column:
    return _struct(VEC, VALUE_TYPE, vec=scalars)


def as_addr(value: Column) -> Column:
    """The address of an address value, else null."""
    return F.when(value["tag"] == ADDR, value["addr"])


def contained_addrs(value: Column) -> Column:
    """The addresses in a value: its own, or those among its list."""
    inner = F.transform(F.filter(F.coalesce(value["vec"], F.array().cast(f"array<{SCALAR_TYPE}>")), lambda s: s["tag"] == ADDR), lambda s: s["addr"])
    return F.when(value["tag"] == ADDR, F.array(value["addr"])).otherwise(inner)


def _show_scalar(s: Column) -> Column:
    return F.when(s["tag"] == U32, s["u32"].cast("string")).when(s["tag"] == STR, s["str"]).otherwise(F.lower(F.hex(s["addr"])))


def display(value: Column) -> Column:
    """Text for people: the number, the string, the address in hex, or a list joined by commas."""
    return F.when(value["tag"] == VEC, F.array_join(F.transform(value["vec"], _show_scalar), ",")).otherwise(_show_scalar(value))


def escape(c: Column) -> Column:
    """Text in which = | , and \\ are marked, so that joined parts stay apart."""
    return F.regexp_replace(c, r"([\\|=,])", r"\\$1")


def encode(value: Column) -> Column:
    """The one canonical text of a value: equal values, and only those, have equal texts."""

    def scalar(s: Column) -> Column:
        return F.when(s["tag"] == U32, F.concat(F.lit("u"), s["u32"].cast("string"))).when(s["tag"] == STR, F.concat(F.lit("s"), escape(s["str"]))).otherwise(F.concat(F.lit("a"), F.lower(F.hex(s["addr"]))))

    return F.when(value["tag"] == VEC, F.concat(F.lit("v"), F.array_join(F.transform(value["vec"], scalar), ","))).otherwise(scalar(value))


def encode_columns(*cols: Column) -> Column:
    """Canonical text of several columns; null differs from any text."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("s"), escape(c.cast("string"))), F.lit("n")) for c in cols])


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def decode(c: Column) -> Column:
    """The value that a canonical text stands for: the reverse of ``encode``."""

    def scalar(x: Column) -> Column:
        kind, rest = F.substring(x, 1, 1), x.substr(F.lit(2), F.length(x))
        return F.when(kind == "u", u32(F.when(kind == "u", rest.try_cast("bigint")), SCALAR_TYPE)).when(kind == "s", text(unescape(rest), SCALAR_TYPE)).when(kind == "a", addr(F.unhex(F.when(kind == "a", rest)), SCALAR_TYPE))

    parts = F.transform(F.regexp_extract_all(c.substr(F.lit(2), F.length(c)), F.lit(r"((?:[^\\,]|\\.)+)")), scalar)
    one = scalar(c)
    return F.when(F.substring(c, 1, 1) == "v", vec(parts)).otherwise(F.when(one.isNotNull(), F.struct(one["tag"].alias("tag"), one["addr"].alias("addr"), one["u32"].alias("u32"), one["str"].alias("str"), F.lit(None).alias("vec")).cast(VALUE_TYPE)))


def order_key(value: Column) -> Column:
    """A text that sorts as its scalar does: by kind first, then numbers by size, strings and addresses by their bytes."""
    return F.when(value["tag"] == U32, F.concat(F.lit("1"), F.lpad(value["u32"].cast("string"), 10, "0"))).when(value["tag"] == STR, F.concat(F.lit("2"), value["str"])).otherwise(F.concat(F.lit("0"), F.lower(F.hex(value["addr"]))))


def key_text(key: int | str | bytes) -> str:
    """order_key of one key on the driver."""
    if isinstance(key, bytes):
        return "0" + key.hex()
    if isinstance(key, str):
        return "2" + key
    if not 0 <= key <= MAX_U32:
        raise InvalidInput(f"not an unsigned 32-bit number: {key}")
    return f"1{key:010d}"


def key_of(text_: str) -> int | str | bytes:
    """The key that an order_key stands for."""
    rest = text_[1:]
    return bytes.fromhex(rest) if text_[0] == "0" else int(rest) if text_[0] == "1" else rest


def push(path: Column, segment: Column) -> Column:
    return F.concat(path, F.array(segment))


def pop(path: Column) -> Column:
    """A path without its last segment; the empty path stays."""
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def last_segment(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def upwards(path: Column) -> Column:
    """Each segment with its depth, from the last one to the first: the way from a leaf to the root."""
    return F.reverse(F.transform(path, lambda x, i: F.struct(i.cast("bigint").alias("depth"), x.alias("segment"))))


def parse_scalar(c: Column) -> Column:
    """A scalar from what a user typed: digits are numbers, ``u32:``, ``str:`` and ``addr:`` (64 hex digits) say the type."""
    kind = F.lower(F.regexp_extract(c, r"^(?i)(u32|str|addr):", 1))
    rest = F.regexp_replace(c, r"^(?i)(?:u32|str|addr):", "")
    number = rest.try_cast("bigint")
    is_number = ((kind == "u32") | ((kind == "") & c.rlike("^[0-9]+$"))) & F.coalesce(u32_ok(number), F.lit(False))
    is_addr = (kind == "addr") & rest.rlike("^[0-9a-fA-F]{64}$")
    return (
        F.when(is_number, u32(F.when(is_number, number), SCALAR_TYPE))
        .when(is_addr, addr(F.unhex(F.when(is_addr, rest)), SCALAR_TYPE))
        .when(kind == "str", text(rest, SCALAR_TYPE))
        .when(kind == "", text(c, SCALAR_TYPE))
    )


def parse_path(c: Column) -> Column:
    """The segments of a path: cut at /, where \\/ stands for / itself; empty text is the empty path."""
    parts = F.split(c, r"(?<!\\)/")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda p: F.replace(p, F.lit("\\/"), F.lit("/"))))


def scalar_of(token: str) -> int | str | bytes:
    """parse_scalar for one string on the driver; a typed scalar that does not fit raises."""
    m = re.match(r"(?i)(u32|str|addr):(.*)", token, re.S)
    kind, rest = (m[1].lower(), m[2]) if m else ("", token)
    if kind == "u32" or not kind and rest.isascii() and rest.isdigit():
        if rest.isascii() and rest.isdigit() and int(rest) <= MAX_U32:
            return int(rest)
        if kind:
            raise InvalidInput(f"not an unsigned 32-bit number: {rest}")
    if kind == "addr":
        if not re.fullmatch(r"[0-9a-fA-F]{64}", rest):
            raise InvalidInput(f"not an address: {rest}")
        return bytes.fromhex(rest)
    return rest


def path_of(token: str) -> list[int | str | bytes]:
    return [scalar_of(p.replace("\\/", "/")) for p in re.split(r"(?<!\\)/", token)] if token else []
