"""Any query on a checked-out version: what Spark itself offers, on the orders map after a batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakecairn.operators import maps
from lakecairn.plans.q_maps import _NEW, changes, orders
from lakecairn.plans.registry import query, table


def _version(spark, d):
    return maps.apply(orders(spark, d), changes(spark, d), ["o_orderkey"])


_V = f"with v(o_orderkey, o_orderstatus, o_totalprice) as ({_NEW}) "


def _cents(c):
    return F.sum(F.col(c).cast("decimal(15,2)")).cast("decimal(25,2)")


@query(_V + "select o_orderstatus, count(*) as n, sum(o_totalprice::decimal(15,2))::decimal(25,2) as total from v group by o_orderstatus")
def agg_on_version(spark, d):
    return _version(spark, d).groupBy("o_orderstatus").agg(F.count("*").alias("n"), _cents("o_totalprice").alias("total"))


@query(_V + "select o_orderstatus, l_returnflag, count(*) as n, sum(l_quantity::decimal(15,2))::decimal(25,2) as qty from v join lineitem on l_orderkey = o_orderkey group by all")
def join_on_version(spark, d):
    v, li = _version(spark, d), table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    return v.join(li, v["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), _cents("l_quantity").alias("qty"))


@query(_V + "select o_orderkey, o_orderstatus, r::int as r from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r from v) where r <= 10")
def window_on_version(spark, d):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _version(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 10").select("o_orderkey", "o_orderstatus", "r")


@query(_V + "select o_orderstatus, o_orderkey % 2 as parity, count(*) as n from v group by rollup (o_orderstatus, o_orderkey % 2)")
def rollup_on_version(spark, d):
    return _version(spark, d).select("o_orderstatus", (F.col("o_orderkey") % 2).alias("parity")).rollup("o_orderstatus", "parity").agg(F.count("*").alias("n"))
