"""Queries on content-addressed trees over the customer map."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.operators import tree
from lakecairn.plans.registry import query, table

#: Levels that the SQL form is unrolled to; a tree is done before, and the rest pass one node through.
_LEVELS = 6


def items(spark, d):
    return table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("k"), F.col("c_name").alias("v"))


_ESC = r"replace(replace(replace(replace({c}, '\', '\\'), '|', '\|'), '=', '\='), ',', '\,')"


def _level_sql(i: int) -> str:
    source = "items" if i == 0 else f"(select first_key as k, addr as v from n{i - 1})"
    keep = "" if i == 0 else f"where (select count(*) from n{i - 1}) > 1"
    return f"""e{i} as (select k, v, substr(sha256(k || '|' || v), 8, 1) = 'f' as last_one from {source} {keep}),
b{i} as (select k, v, coalesce(sum(case when last_one then 1 else 0 end) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as block from e{i}),
n{i} as (select {i} as level, block, min(k) as first_key, count(*)::int as n, sha256('L{i}:' || string_agg({_ESC.format(c="k")} || '=' || {_ESC.format(c="v")}, '|' order by k)) as addr from b{i} group by block)"""


def _tree_sql(levels: int, select: str) -> str:
    return "with items as (select lpad(c_custkey::varchar, 12, '0') as k, c_name as v from customer),\n" + ",\n".join(_level_sql(i) for i in range(levels)) + "\n" + select


@query(_tree_sql(1, "select k, last_one as ends, block from e0 join b0 using (k)"))
def block_ids(spark, d):
    rows = items(spark, d).withColumn("ends", tree.ends_block(F.col("k"), F.col("v")))
    return tree.block_ids(rows, "k", "ends", partitions=4).select("k", "ends", "block")


@query(_tree_sql(1, "select level, block, first_key, n, addr from n0"))
def leaf_blocks(spark, d):
    return tree.blocks(items(spark, d), 0).select("level", "block", "first_key", "n", "addr")


@query(_tree_sql(_LEVELS, "select level, addr as root from (" + " union all ".join(f"select level, addr, (select count(*) from n{i}) as c from n{i}" for i in range(_LEVELS)) + ") where c = 1 order by level limit 1"))
def tree_root(spark, d):
    return tree.root(tree.build(items(spark, d)))


@query("select lpad(c_custkey::varchar, 12, '0') as k, c_name as v from customer")
def tree_scan(spark, d):
    return tree.scan(tree.build(items(spark, d)))


@query("select lpad(c_custkey::varchar, 12, '0') as k, c_name as v from customer where c_custkey = 42")
def tree_get(spark, d):
    return tree.get(tree.build(items(spark, d)), "000000000042")


@query(
    _tree_sql(
        1,
        ", q as (select distinct lpad((o_custkey)::varchar, 12, '0') as k from orders) select q.k, n0.block from q asof left join n0 on q.k >= n0.first_key",
    ).replace("\n, q as", ",\nq as")
)
def block_asof(spark, d):
    keys = table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("k")).distinct()
    return tree.block_of(keys, "k", tree.blocks(items(spark, d), 0))


@query(_tree_sql(1, "select block, first_key, lead(first_key) over (order by first_key) as next_key from n0"))
def block_right_neighbor(spark, d):
    return tree.neighbours(tree.blocks(items(spark, d), 0)).select("block", "first_key", "next_key")


@query(
    _tree_sql(_LEVELS, "select level, addr as root from (" + " union all ".join(f"select level, addr, (select count(*) from n{i}) as c from n{i}" for i in range(_LEVELS)) + ") where c = 1 order by level limit 1").replace(
        "select lpad(c_custkey::varchar, 12, '0') as k, c_name as v from customer",
        "select lpad(c_custkey::varchar, 12, '0') as k, case when c_custkey % 50 = 3 then 'new' else c_name end as v from customer where c_custkey % 50 <> 7",
    )
)
def tree_update(spark, d):
    """The root after a batch on the stored tree: equal to that of a full build of the new content."""
    base = items(spark, d)
    n = F.col("k").cast("bigint") % 50
    some = base.filter(n.isin(3, 7)).select("k", F.when(n == 3, "insert").otherwise("remove").alias("op"), F.lit("new").alias("v"))
    return tree.root(tree.update(tree.build(base), some))
