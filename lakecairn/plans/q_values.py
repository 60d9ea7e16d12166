"""Queries on values, ids, codecs and paths as columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.functions import hashing, head, values
from lakecairn.operators import tree
from lakecairn.plans.q_tree import _tree_sql, items
from lakecairn.plans.registry import query, table


def _listed(spark, d):
    """A list of a name, a number and an address for every customer."""
    c = table(spark, d, "customer")
    at = F.unhex(F.lpad(F.hex("c_custkey"), 64, "0"))
    return c.select("c_custkey", "c_name", "c_nationkey", values.vec(F.array(values.text(F.col("c_name"), values.SCALAR_TYPE), values.u32(F.col("c_nationkey"), values.SCALAR_TYPE), values.addr(at, values.SCALAR_TYPE))).alias("v"))


@query("select c_custkey, c_name as str, c_nationkey::bigint as u32, lower(lpad(to_base(c_custkey, 16), 64, '0')) as addr, 3 as tag from customer")
def value_decode(spark, d):
    """Lists to their canonical text and back."""
    back = _listed(spark, d).select("c_custkey", values.decode(values.encode(F.col("v"))).alias("v"))
    return back.select("c_custkey", F.col("v.vec")[0]["str"].alias("str"), F.col("v.vec")[1]["u32"].alias("u32"), F.lower(F.hex(F.col("v.vec")[2]["addr"])).alias("addr"), F.col("v.tag").cast("int").alias("tag"))


@query("select c_custkey, lower(lpad(to_base(c_custkey, 16), 64, '0')) as inside, 1 as n, true as alone from customer")
def contained_addrs(spark, d):
    """The addresses in a list, and that of an address alone."""
    found = _listed(spark, d).select("c_custkey", values.contained_addrs(F.col("v")).alias("a"), values.addr(F.unhex(F.lpad(F.hex("c_custkey"), 64, "0"))).alias("one"))
    alone = (F.lower(F.hex(values.as_addr(F.col("one")))) == F.lower(F.hex(F.col("a")[0]))) & (F.size(values.contained_addrs(F.col("one"))) == 1)
    return found.select("c_custkey", F.lower(F.hex(F.col("a")[0])).alias("inside"), F.size("a").alias("n"), alone.alias("alone"))


@query("select event_id, rpad(lpad(to_base(event_id, 16), 8, '0'), 16, '0') as rid, event_type || '/' || event_id::varchar as key, true as ok from events")
def int_ids(spark, d):
    e = table(spark, d, "events")
    rid = hashing.int_id(F.col("event_id"), 8)
    return e.select("event_id", F.hex(rid).alias("rid"), hashing.replica_key(F.col("event_type"), F.col("event_id").cast("string")).alias("key"), hashing.id_ok(rid, 8).alias("ok"))


_GROUP = "lpad(lower(to_base(('0x' || substr(h, {at}, 10))::bigint, 32)), 8, '0')"


@query(f"with u as (select event_id, left(sha256(event_id::varchar), 40) as h from events) select event_id, 'v' || {' || '.join(_GROUP.format(at=a) for a in (1, 11, 21, 31))} as id from u")
def base32_ids(spark, d):
    """Ids of 20 bytes as text that may be a file's name."""
    whole = F.unhex(F.substring(hashing.content_id(F.col("event_id").cast("string")), 1, 40))
    return table(spark, d, "events").select("event_id", hashing.base32hex(whole).alias("id"))


# The last digit of four bytes holds the two bits that are left and three zeros.
_SHORT = "with u as (select event_id, left(sha256(event_id::varchar), 8) || '00' as h from events) select event_id, 'v' || left(" + _GROUP.format(at=1) + ", 7) as short from u"


@query(_SHORT)
def base32_short(spark, d):
    four = F.unhex(F.substring(hashing.content_id(F.col("event_id").cast("string")), 1, 8))
    return table(spark, d, "events").select("event_id", hashing.base32hex(four).alias("short"))


@query("select doc_id, sha256(text) as cid, true as same, true as bad from documents")
def base58_round_trip(spark, d):
    """Ids to base 58 and back; text that is none gives null."""
    rows = table(spark, d, "documents").select("doc_id", hashing.content_id(F.col("text")).alias("cid"))
    back = hashing.decode_base58(hashing.encode_base58(F.unhex("cid")))
    return rows.select("doc_id", F.lower(F.hex(back)).alias("cid"), (F.unhex("cid") == back).alias("same"), hashing.decode_base58(F.concat(F.lit("z0"), F.col("cid"))).isNull().alias("bad"))


@query("""select event_id, case when event_id % 3 = 0 then 'detached: ' || sha256(event_id::varchar) when event_id % 3 = 1 then 'branch: ' || event_type
    else 'branch: ' || event_type || chr(10) || 'staged_content: ' || sha256(event_id::varchar) end as head, case when event_id % 3 > 0 then event_type end as branch from events""")
def head_text(spark, d):
    """Heads of workspaces to text, and the branch read from it."""
    e = table(spark, d, "events")
    cid, rest = hashing.content_id(F.col("event_id").cast("string")), F.col("event_id") % 3
    rows = e.select("event_id", head.to_text(F.when(rest > 0, F.col("event_type")), F.when(rest == 2, cid), F.when(rest == 0, cid)).alias("head"))
    return rows.select("event_id", "head", head.from_text(F.col("head"))["branch"].alias("branch"))


@query(_tree_sql(1, "select count(*) as nodes, sum(n)::bigint as items, bool_or(n = 0) as any_empty from n0"))
def node_sizes(spark, d):
    leaves = tree.blocks(items(spark, d), 0)
    return leaves.agg(F.count("*").alias("nodes"), F.sum("n").cast("bigint").alias("items"), F.bool_or(F.col("n") == 0).alias("any_empty"))


@query("""
with p as (select page_id, string_split(url, '/') as s from pages)
select page_id, array_to_string(s[1:len(s) - 1], '/') as parent, s[len(s)] as name, array_to_string(list_append(s, 'more'), '/') as below,
    array_to_string(list_transform(range(len(s), 0, -1), lambda i: (i - 1)::varchar || ':' || s[i]), ' ') as up, len(s) - 1 as parent_len from p""")
def path_algebra(spark, d):
    """Parents, names, longer paths, and the way up from the last segment."""
    p = table(spark, d, "pages").select("page_id", values.parse_path(F.col("url")).alias("p"))
    up = F.array_join(F.transform(values.upwards(F.col("p")), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["segment"])), " ")
    parent = values.pop(F.col("p"))
    return p.select("page_id", F.array_join(parent, "/").alias("parent"), values.last_segment(F.col("p")).alias("name"), F.array_join(values.push(F.col("p"), F.lit("more")), "/").alias("below"), up.alias("up"), F.size(parent).cast("bigint").alias("parent_len"))
