"""Queries on key listings, last-writer-wins metadata and heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.operators import maps
from lakecairn.operators.listing import listing
from lakecairn.plans.registry import query, table
from lakecairn.sources.store import heads_of


@query("select distinct url as key from pages where starts_with(url, 'https://')")
def list_prefix(spark, d):
    return listing(table(spark, d, "pages"), "url", "https://")


@query("""
with r as (select url, substr(url, 9) as rest from pages where starts_with(url, 'https://'))
select distinct case when contains(rest, '/') then 'https://' || split_part(rest, '/', 1) || '/' else url end as key from r""")
def list_delimited(spark, d):
    return listing(table(spark, d, "pages"), "url", "https://", "/")


_META = "select event_type || '/' || user_id::varchar as key, event_id, event_type, user_id from events"


def _meta(spark, d):
    """Heads of replicas: remote is the event type, rid the user, and the last event the head."""
    return table(spark, d, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), "event_id")


@query("select user_id::varchar as key, arg_max(event_type, event_id) as value from events group by 1")
def meta_lww(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "event_type")
    return maps.latest(e, ["key"], F.col("event_id"), F.col("event_type"), "value")


@query(f"with m as ({_META}) select distinct substr(key, length('click/') + 1) as rid from m where starts_with(key, 'click/')")
def replicas_list(spark, d):
    found = listing(_meta(spark, d), "key", "click/")
    return found.select(F.expr("substring(key, length('click/') + 1)").alias("rid"))


@query(f"with m as ({_META}) select key, max(event_id)::varchar as head from m where key = 'click/1' group by key")
def head_lookup(spark, d):
    return _meta(spark, d).filter("key = 'click/1'").groupBy("key").agg(F.max("event_id").cast("string").alias("head"))


@query(f"""
with m as ({_META}), h as (select key, max(event_id)::varchar as head from m group by key)
select c_custkey as rid, head from customer left join h on h.key = 'click/' || c_custkey::varchar""")
def heads_join(spark, d):
    meta = _meta(spark, d).groupBy("key").agg(F.max("event_id").cast("string").alias("head"))
    rids = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"))
    return heads_of(meta, F.lit("click"), rids)
