"""Queries on counters, clocks, sets and ordered bags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakecairn.operators import crdt, sets
from lakecairn.plans.registry import query, table


def _counters(spark, d, where="true"):
    return crdt.increments(table(spark, d, "events").filter(where), "event_type", "user_id")


_INC = "select event_type as counter, user_id as rid, count(*) as n from events {w} group by all"
_A, _B = "event_id % 3 <> 0", "event_id % 3 <> 1"


@query(_INC.format(w=""))
def gcounter_inc(spark, d):
    return _counters(spark, d)


@query(f"select counter, sum(n)::bigint as value from ({_INC.format(w='')}) group by counter")
def gcounter_value(spark, d):
    return crdt.value(_counters(spark, d))


@query(f"select * from ({_INC.format(w='')}) where counter = 'click' and rid = 1")
def gcounter_get(spark, d):
    return crdt.get(_counters(spark, d), "click", 1)


@query(f"select counter, rid, max(n) as n from ({_INC.format(w='where ' + _A)} union all {_INC.format(w='where ' + _B)}) group by counter, rid")
def gcounter_merge(spark, d):
    return crdt.merge(_counters(spark, d, _A), _counters(spark, d, _B))


@query("select event_type as counter, (count(*) filter (event_id % 2 = 0) - count(*) filter (event_id % 2 = 1))::bigint as value from events group by 1")
def pncounter_value(spark, d):
    """Every event counts: even ones up, odd ones down."""
    return crdt.pn_value(_counters(spark, d, "event_id % 2 = 0"), _counters(spark, d, "event_id % 2 = 1"))


@query(f"""
with l as ({_INC.format(w='where ' + _A)}), r as ({_INC.format(w='where ' + _B)}),
b as (select coalesce(l.rid, r.rid) as clock, coalesce(l.n, 0) as l, coalesce(r.n, 0) as r from l full join r on l.counter = r.counter and l.rid = r.rid)
select clock, case when bool_or(l < r) and bool_or(l > r) then 'concurrent' when bool_or(l < r) then 'before' when bool_or(l > r) then 'after' else 'equal' end as ordering
from b group by clock""")
def vclock_compare(spark, d):
    """One clock a user: its replicas are the event types."""
    clock = lambda w: _counters(spark, d, w).select(F.col("rid").alias("clock"), F.col("counter").alias("rid"), "n")
    return crdt.compare_clocks(clock(_A), clock(_B))


@query("select user_id, max(event_id) as top from events group by user_id")
def mergeable_register(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("top"))
    return crdt.merge_by(e, ["user_id"], "top", crdt.MaxRegister())


def _brands(spark, d):
    return sets.create(table(spark, d, "part"), "p_brand")


def _types(spark, d):
    return sets.create(table(spark, d, "part").filter("p_size > 25"), "p_brand")


@query("select distinct sha256(p_brand) as hash, p_brand as value from part")
def set_distinct(spark, d):
    return _brands(spark, d)


@query("select hash, value, row_number() over (order by hash)::int as rank from (select distinct sha256(p_type) as hash, p_type as value from part)")
def set_hash_order(spark, d):
    return sets.ordered(sets.create(table(spark, d, "part"), "p_type"))


@query("select value, value in (select p_brand from part where p_size > 25) as contained from (select distinct p_brand as value from part union all select 'no such brand')")
def set_contains(spark, d):
    wanted = _brands(spark, d).select("value").unionByName(spark.createDataFrame([("no such brand",)], "value string"))
    return sets.contains(_types(spark, d), wanted)


@query("select distinct sha256(v) as hash, v as value from (select p_brand as v from part union select p_type from part)")
def set_union(spark, d):
    return sets.union(_brands(spark, d), sets.create(table(spark, d, "part"), "p_type"))


@query("with p as (select p_brand || ' ' || p_size as v, p_type from part) select distinct sha256(v) as hash, v as value from p where v not in (select v from p where p_type = 'PROMO')")
def set_except(spark, d):
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_size").alias("v"), "p_type")
    return sets.except_(sets.create(p, "v"), sets.create(p.filter("p_type = 'PROMO'"), "v"))


@query("""
with ops as (select -1::bigint as seq, 'insert' as op, p_brand as value from part
    union all select p_partkey, case when p_partkey % 2 = 0 then 'insert' else 'remove' end, case when p_partkey % 3 = 0 then p_brand else p_type end from part)
select sha256(value) as hash, value from ops group by value having arg_max(op, seq) = 'insert'""")
def set_update(spark, d):
    p = table(spark, d, "part")
    ops = p.select(F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 2 == 0, "insert").otherwise("remove").alias("op"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("value"))
    return sets.update(_brands(spark, d), ops)


@query("select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::bigint as pos, role, text from conversations")
def list_roundtrip(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return sets.positions(rows, "turn", group="conv_id").select("conv_id", "pos", "role", "text")


@query("""
select conv_id, bool_and(before is null or before <= turn) as sorted, count(*) as n
from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from conversations) group by conv_id""")
def sorted_check(spark, d):
    rows = table(spark, d, "conversations").withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.bool_and(crdt.is_sorted(F.col("turn"), F.col("before"))).alias("sorted"), F.count("*").alias("n"))
