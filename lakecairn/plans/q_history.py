"""Queries on logs, heads, commits, workspaces and nested paths; events play the log of operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.functions.hashing import content_id
from lakecairn.operators import history, paths
from lakecairn.plans.registry import query, table

_ORDER = ["ts", "event_id"]
_LOG = "select event_id, ts, user_id, event_type, sha256(user_id::varchar || '|' || event_type) as content, sha256(event_id::varchar) as addr from events"


def log(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    text = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return e.withColumn("content", content_id(text)).withColumn("addr", content_id(F.col("event_id").cast("string")))


@query(f"with l as ({_LOG}) select event_id, addr, lag(addr) over (partition by user_id order by ts, event_id) as prev from l")
def log_prev(spark, d):
    return history.link(log(spark, d), "user_id", _ORDER).select("event_id", "addr", "prev")


@query(f"with l as ({_LOG}) select user_id, event_id, addr, content from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from l) where r = 1")
def head_commit(spark, d):
    return history.head(log(spark, d), "user_id", _ORDER).select("user_id", "event_id", "addr", "content")


_CHANGED = f"""with l as ({_LOG}), c as (select *, lag(content) over (partition by user_id order by ts, event_id) as before from l)
select {{cols}} from c where before is null or before <> content"""


@query(_CHANGED.format(cols="user_id, event_id, content"))
def commit_dedup(spark, d):
    return history.changed(log(spark, d), "user_id", _ORDER, "content").select("user_id", "event_id", "content")


@query(f"select user_id, event_id, content, lag(content) over (partition by user_id order by ts, event_id) as prev from ({_CHANGED.format(cols='user_id, event_id, ts, content')})")
def commit_history(spark, d):
    kept = history.changed(log(spark, d), "user_id", _ORDER, "content")
    return history.link(kept, "user_id", _ORDER, addr="content").select("user_id", "event_id", "content", "prev")


@query(f"with l as ({_LOG}) select (select count(*) from l) as n_commits, count(*) as n_written, ((select count(*) from l) - count(*)) as n_noop from ({_CHANGED.format(cols='user_id')})")
def commit_noop(spark, d):
    rows = history.written(log(spark, d), "user_id", _ORDER, "content")
    return rows.agg(F.count("*").alias("n_commits"), F.count_if("_written").alias("n_written"), F.count_if(~F.col("_written")).alias("n_noop"))


@query(f"with l as ({_LOG}) select user_id, event_id, content as tip, lag(content) over (partition by user_id order by ts, event_id) is distinct from content as dirty from l")
def repo_tip_upsert(spark, d):
    rows = log(spark, d).withColumnRenamed("content", "tip")
    return history.tips(rows, ["user_id"], _ORDER, "tip").select("user_id", "event_id", "tip", "dirty")


@query(f"""
with l as ({_LOG}), h as (select user_id, arg_max(content, event_id) as tip from l group by user_id)
select c_custkey as repo, tip, case when tip is null then 'default' else 'open' end as state from customer left join h on c_custkey = user_id""")
def open_tip(spark, d):
    heads = history.head(log(spark, d).select("user_id", "event_id", "content"), "user_id", ["event_id"])
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"))
    found = repos.join(heads, repos["repo"] == heads["user_id"], "left")
    return found.select("repo", F.col("content").alias("tip"), F.when(F.col("content").isNull(), "default").otherwise("open").alias("state"))


_OPS = "select event_id, ts, user_id, case when event_id % 3 = 0 then 'commit' else 'stage' end as action, sha256(event_id::varchar) as addr from events"
_REPLAY = f"""
with o as ({_OPS}), p as (select *, coalesce(lag(action) over w = 'stage', false) and action = 'commit' as good from o window w as (partition by user_id order by ts, event_id)),
c as (select *, last_value(case when good then addr end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as "commit" from p)
"""


def _ops(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", F.when(F.col("event_id") % 3 == 0, "commit").otherwise("stage").alias("action"), content_id(F.col("event_id").cast("string")).alias("addr"))


@query(
    _REPLAY
    + """select event_id, user_id, action,
    case when action = 'stage' and "commit" is null then 'init_staged' when action = 'stage' then 'staged' when "commit" is null then 'init' else 'clean' end as status,
    case when action = 'stage' then addr end as staged, "commit", case when action = 'commit' and not good then 'CommitEmptyStage' end as error from c"""
)
def workspace_replay(spark, d):
    return history.replay(_ops(spark, d), "user_id", _ORDER).select("event_id", "user_id", "action", "status", "staged", "commit", "error")


@query(_REPLAY + """select event_id, user_id, coalesce(case when action = 'stage' then addr end, "commit") as content from c""")
def visible_content(spark, d):
    rows = history.replay(_ops(spark, d), "user_id", _ORDER)
    return rows.select("event_id", "user_id", history.visible(F.col("staged"), F.col("commit")).alias("content"))


def nested(spark, d):
    """region / nation / customer as maps in maps: rows (map, key, child)."""
    r = table(spark, d, "region").select(F.lit("").alias("map"), F.col("r_name").alias("key"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("map"), F.col("n_name").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("map"), F.col("c_name").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return r.unionByName(n).unionByName(c)


_NESTED = """select '' as map, r_name as key, 'r' || r_regionkey as child from region
union all select 'r' || n_regionkey, n_name, 'n' || n_nationkey from nation
union all select 'n' || c_nationkey, c_name, 'c' || c_custkey from customer"""


@query("""
select c_custkey as path_id, 'r' || n_regionkey as child_0,
    case when c_custkey % 4 <> 0 then 'n' || c_nationkey end as child_1, case when c_custkey % 4 <> 0 then 'c' || c_custkey end as child_2
from customer join nation on c_nationkey = n_nationkey""")
def path_resolve(spark, d):
    """Every fourth path has a wrong second segment: it and what follows resolve to nothing."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    p = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    p = p.select(F.col("c_custkey").alias("path_id"), F.lit("").alias("root"), F.array("r_name", F.when(F.col("c_custkey") % 4 == 0, F.lit("?")).otherwise(F.col("n_name")), "c_name").alias("path"))
    return paths.resolve(nested(spark, d), p, 3).select("path_id", "child_0", "child_1", "child_2")


@query(f"""
with e as ({_NESTED}), new(map, key, child) as (values ('', 'NEW', '/NEW'), ('/NEW', 'LAND', '/NEW/LAND'), ('/NEW/LAND', 'me', '7'))
select * from e union all select * from new""")
def path_insert(spark, d):
    return paths.insert(nested(spark, d), ["NEW", "LAND", "me"], "7")


@query(f"""
with e as ({_NESTED}) select map, sha256(string_agg(replace(replace(replace(key, '\\', '\\\\'), '=', '\\='), ',', '\\,') || '=' || child, '|' order by key)) as addr from e group by map""")
def path_address(spark, d):
    return paths.address(nested(spark, d))


@query(f"with l as ({_LOG}) select event_id, addr, lag(addr) over (order by ts, event_id) as prev, coalesce(lag(content) over (order by ts, event_id) <> content, true) as dirty from l")
def one_long_log(spark, d):
    """All events as one log, which goes over several tasks."""
    rows = log(spark, d).withColumn("log", F.lit("all"))
    linked = history.link(rows, "log", _ORDER, hot=True)
    return history.tips(linked, ["log"], _ORDER, "content", hot=True).select("event_id", "addr", "prev", "dirty")


@query(
    _REPLAY.replace("partition by user_id ", "")
    + """select event_id, action, staged_now as staged, "commit", status from (select *, case when action = 'stage' then addr end as staged_now,
    case when action = 'stage' and "commit" is null then 'init_staged' when action = 'stage' then 'staged' when "commit" is null then 'init' else 'clean' end as status from c)"""
)
def one_long_workspace(spark, d):
    """All events as the operations on one workspace, which go over several tasks."""
    ops = _ops(spark, d).withColumn("log", F.lit("all"))
    return history.replay(ops, "log", _ORDER, hot=True).select("event_id", "action", "staged", "commit", "status")


@query(f"""
with e as ({_NESTED}), asked as (select c_custkey as path_id, r_name as s0, case when c_custkey % 4 = 0 then '?' else n_name end as s1, c_name as s2, c_custkey % 3 = 0 as deeper
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select path_id, case when deeper and s1 <> '?' then 'WrongType' end as error from asked""")
def path_type_check(spark, d):
    """Every third path goes on below a customer, which is no map."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    p = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    second = F.when(F.col("c_custkey") % 4 == 0, F.lit("?")).otherwise(F.col("n_name"))
    path = F.concat(F.array("r_name", second, "c_name"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("below"))).otherwise(F.array().cast("array<string>")))
    asked = p.select(F.col("c_custkey").alias("path_id"), F.lit("").alias("root"), path.alias("path"))
    found = paths.resolve(nested(spark, d), asked, 4)
    return found.select("path_id", paths.wrong_type(4, lambda child: child.startswith("c")).alias("error"))


_ADDR = r"sha256(string_agg(replace(replace(replace(key, '\', '\\'), '=', '\='), ',', '\,') || '=' || child, '|' order by key))"


@query(f"""
with e as ({_NESTED}), place as (select 'r' || r_regionkey as r, r_name, 'n' || n_nationkey as n, n_name from region join nation on n_regionkey = r_regionkey where n_nationkey = 3),
low as (select key, child from e, place where map = n union all select 'NEW', '7'),
low_at as (select {_ADDR} as a from low),
mid as (select key, case when key = n_name then a else child end as child from e, place, low_at where map = r),
mid_at as (select {_ADDR} as a from mid),
top as (select key, case when key = r_name then a else child end as child from e, place, mid_at where map = ''),
top_at as (select {_ADDR} as a from top)
select a as map, key, child from low, low_at union all select a, key, child from mid, mid_at union all select a, key, child from top, top_at""")
def path_update(spark, d):
    """A value put under a nation: its map and the maps above it get new addresses, and the old ones stay."""
    entries = nested(spark, d)
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    where = n.filter("n_nationkey = 3").join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name").first()
    new, _ = paths.update(entries, [*where, "NEW"], "7")
    return new
