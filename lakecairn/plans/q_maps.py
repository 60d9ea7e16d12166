"""Queries on versioned maps: point, range and prefix reads, batches of changes, diffs, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.functions import values
from lakecairn.operators import maps
from lakecairn.plans.registry import query, table

_COLS = "o_orderkey, o_orderstatus, o_totalprice"


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def changes(spark, d):
    """A batch over orders: keys ending in 3 upserted with status U, in 7 removed, and new keys inserted."""
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 10 in (3, 7)").select(F.col("o_orderkey").alias("seq"), "o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, maps.INSERT).otherwise(maps.REMOVE).alias("op"), F.lit("U").alias("o_orderstatus"), "o_totalprice")
    new = o.filter("o_orderkey % 10 = 5").select(F.col("o_orderkey").alias("seq"), (-F.col("o_orderkey")).alias("o_orderkey"), F.lit(maps.INSERT).alias("op"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return old.unionByName(new)


_NEW = f"""select {_COLS} from orders where o_orderkey % 10 not in (3, 7)
union all select o_orderkey, 'U', o_totalprice from orders where o_orderkey % 10 = 3
union all select -o_orderkey, 'N', o_totalprice from orders where o_orderkey % 10 = 5"""


@query(f"select {_COLS} from orders where o_orderkey = 77")
def map_get(spark, d):
    return maps.get(orders(spark, d), "o_orderkey", 77)


_RANGES = {
    "map_range": (dict(start=100, end=500), "o_orderkey >= 100 and o_orderkey < 500"),
    "map_range_from": (dict(start=300), "o_orderkey >= 300"),
    "map_range_to": (dict(end=500), "o_orderkey < 500"),
    "map_range_incl": (dict(start=100, end=500, end_closed=True), "o_orderkey >= 100 and o_orderkey <= 500"),
    "map_range_to_incl": (dict(end=500, end_closed=True), "o_orderkey <= 500"),
    "map_range_full": ({}, "true"),
}
for _name, (_bounds, _where) in _RANGES.items():
    query(f"select {_COLS} from orders where {_where}", _name)(lambda spark, d, b=_bounds: maps.scan(orders(spark, d), "o_orderkey", **b))


@query("select page_id, url from pages where starts_with(url, 'http://')")
def map_prefix(spark, d):
    return maps.prefix(table(spark, d, "pages").select("page_id", "url"), "url", "http://")


@query(f"select {_COLS} from orders where o_orderkey % 10 <> 3 union all select o_orderkey, 'U', o_totalprice from orders where o_orderkey % 10 = 3")
def map_upsert(spark, d):
    o = orders(spark, d)
    return maps.upsert(o, o.filter("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])


@query(f"select {_COLS} from orders where o_orderkey % 10 <> 7")
def map_remove(spark, d):
    o = orders(spark, d)
    return maps.remove(o, o.filter("o_orderkey % 10 = 7"), ["o_orderkey"])


@query(_NEW)
def map_mixed_changes(spark, d):
    return maps.apply(orders(spark, d), changes(spark, d), ["o_orderkey"])


@query(f"with old as (select {_COLS} from orders), now({_COLS}) as ({_NEW}) select now.*, old.o_orderkey is null as added from now left join old on old.o_orderkey = now.o_orderkey")
def map_insert_visible(spark, d):
    """The whole map as it is seen after a batch, with which keys are new."""
    old, now = orders(spark, d), maps.apply(orders(spark, d), changes(spark, d), ["o_orderkey"])
    return now.join(old.select("o_orderkey", F.lit(False).alias("added")), "o_orderkey", "left").withColumn("added", F.coalesce("added", F.lit(True)))


@query("select user_id as k, arg_max(event_type, event_id) as v, max(event_id) as seq from events group by user_id")
def batch_lww(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.lit(maps.INSERT).alias("op"), F.col("event_type").alias("v"))
    return maps.collapse(rows, ["k"]).select("k", "v", "seq")


@query("""
with p as (select user_id as c_custkey, arg_max(event_type, event_id) as ev, max(event_id) as seq from events group by user_id)
select c.c_custkey, coalesce(case when p.ev is null then c_mktsegment else p.ev end, c_mktsegment) as c_mktsegment
from customer c left join p on c.c_custkey = p.c_custkey where p.ev is null or p.ev <> 'logout'
union all select p.c_custkey, ev from p where ev <> 'logout' and not exists (select 1 from customer c where c.c_custkey = p.c_custkey)""")
def batch_read_overlay(spark, d):
    """Stored segments of customers under pending events: a logout removes the key, others replace the value."""
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    pending = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "logout", maps.REMOVE).otherwise(maps.INSERT).alias("op"), F.col("event_type").alias("c_mktsegment"))
    return maps.overlay(base, pending, ["c_custkey"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_key_check(spark, d):
    return maps.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
with old as (select {_COLS} from orders), new as ({_NEW.replace("'U'", "'U' as o_orderstatus").replace("'N'", "'N'").replace("-o_orderkey", "-o_orderkey as o_orderkey")})
select coalesce(old.o_orderkey, new.o_orderkey) as o_orderkey,
    old.o_orderstatus as old_o_orderstatus, old.o_totalprice as old_o_totalprice,
    new.o_orderstatus as new_o_orderstatus, new.o_totalprice as new_o_totalprice,
    case when old.o_orderkey is null then 'added' when new.o_orderkey is null then 'removed' else 'changed' end as change
from old full join new on old.o_orderkey = new.o_orderkey
where old.o_orderkey is null or new.o_orderkey is null
    or old.o_orderstatus is distinct from new.o_orderstatus or old.o_totalprice is distinct from new.o_totalprice""")
def map_diff(spark, d):
    old = orders(spark, d)
    return maps.diff(old, maps.apply(old, changes(spark, d), ["o_orderkey"]), ["o_orderkey"])


@query("select c_custkey, c_custkey::varchar as key_text, c_name || ',' || c_nationkey::varchar as value_text, 'vs' || replace(c_name, ',', '\\,') || ',u' || c_nationkey::varchar as encoded from customer")
def value_display(spark, d):
    c = table(spark, d, "customer")
    parts = F.array(values.text(F.col("c_name"), values.SCALAR_TYPE), values.u32(F.col("c_nationkey"), values.SCALAR_TYPE))
    return c.select("c_custkey", values.display(values.u32(F.col("c_custkey"))).alias("key_text"), values.display(values.vec(parts)).alias("value_text"), values.encode(values.vec(parts)).alias("encoded"))


_TOKENS = "case when c_custkey % 5 = 0 then c_custkey::varchar when c_custkey % 5 = 1 then 'u32:' || c_custkey::varchar when c_custkey % 5 = 2 then 'STR:' || c_custkey::varchar when c_custkey % 5 = 3 then c_name else '99999999999' end"


@query(f"""
with t as (select c_custkey, {_TOKENS} as token from customer)
select c_custkey, case when c_custkey % 5 in (0, 1) then 1 else 2 end as tag,
    case when c_custkey % 5 in (0, 1) then c_custkey end as u32,
    case when c_custkey % 5 = 2 then c_custkey::varchar when c_custkey % 5 > 2 then token end as str
from t""")
def parse_scalar(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 5
    token = F.when(m == 0, k).when(m == 1, F.concat(F.lit("u32:"), k)).when(m == 2, F.concat(F.lit("STR:"), k)).when(m == 3, F.col("c_name")).otherwise(F.lit("99999999999"))
    return c.select("c_custkey", token.alias("token")).withColumn("s", values.parse_scalar(F.col("token"))).select("c_custkey", F.col("s.tag").cast("int").alias("tag"), F.col("s.u32").alias("u32"), F.col("s.str").alias("str"))


@query("select page_id, len(string_split(url, '/')) as n, string_split(url, '/')[3] as host, array_to_string(string_split(url, '/'), '>') as shown from pages")
def parse_path(spark, d):
    p = table(spark, d, "pages").select("page_id", values.parse_path(F.col("url")).alias("p"))
    return p.select("page_id", F.size("p").cast("bigint").alias("n"), F.col("p")[2].alias("host"), F.array_join("p", ">").alias("shown"))
