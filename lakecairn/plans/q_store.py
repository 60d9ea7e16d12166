"""Queries that write to a repository or a store in the shared folder and read back from it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakecairn.functions import hashing
from lakecairn.functions.values import STR, U32, order_key, text, u32
from lakecairn.operators import maps
from lakecairn.operators.lineage import shared_folder
from lakecairn.plans.containers import Container, ContainerRepo
from lakecairn.plans.engine import Engine
from lakecairn.plans.registry import query, table
from lakecairn.sources.store import ContentStore, DelimitedCodec, LargeFileStore, MemoryStore, MetaStore, RecordStore


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def _key(c):
    return F.lpad(c.cast("string"), 12, "0")


_OLD = "select lpad(o_orderkey::varchar, 12, '0') as k, o_orderstatus as v from orders"
_NEW = """select lpad(o_orderkey::varchar, 12, '0') as k, case when o_orderkey % 10 = 3 then 'U' else o_orderstatus end as v from orders where o_orderkey % 10 <> 7
union all select 'n' || o_orderkey::varchar, 'N' from orders where o_orderkey % 10 = 5"""


def _two_versions(spark, d):
    """The orders map, committed, and committed again after a batch; opened anew. Returns the repository and both versions."""
    path = f"{_folder(spark)}/repo"
    o = table(spark, d, "orders")
    repo = Engine.init(spark, path, clock=lambda: 0).repo("orders")
    repo.change(o.select(_key(F.col("o_orderkey")).alias("k"), F.lit(maps.INSERT).alias("op"), F.col("o_orderstatus").alias("v")))
    repo.stage()
    first = repo.commit("load")
    rest = F.col("o_orderkey") % 10
    change = o.filter(rest.isin(3, 7)).select(_key(F.col("o_orderkey")).alias("k"), F.when(rest == 3, maps.INSERT).otherwise(maps.REMOVE).alias("op"), F.lit("U").alias("v"))
    new = o.filter(rest == 5).select(F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("k"), F.lit(maps.INSERT).alias("op"), F.lit("N").alias("v"))
    repo.change(change.unionByName(new))
    repo.stage()
    second = repo.commit("batch")
    return Engine.open(spark, path).repo("orders"), first, second


@query(f"select * from ({_NEW})")
def repo_commit_reopen(spark, d):
    return _two_versions(spark, d)[0].read()


@query(f"select k, v from ({_NEW}) where k in ('000000000003', '000000000004', 'n5', '000000000499')")
def repo_point_read(spark, d):
    repo, _, _ = _two_versions(spark, d)
    asked = ["000000000003", "000000000004", "000000000007", "n5", "000000000499", "zzz", ""]
    rows = [(k, repo.get(k)) for k in asked]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "k string, v string")


@query(f"select k, v from ({_NEW}) where k >= '000000000100' and k < '000000000500'")
def repo_range_read(spark, d):
    return _two_versions(spark, d)[0].range("000000000100", "000000000500")


@query(f"select * from ({_OLD})")
def repo_old_version(spark, d):
    """The first version, after the second was committed."""
    repo, first, _ = _two_versions(spark, d)
    repo.checkout(first)
    return repo.read()


@query(f"""
with a as ({_OLD}), b as ({_NEW})
select coalesce(a.k, b.k) as k, a.v as old_v, b.v as new_v, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change
from a full join b on a.k = b.k where a.v is distinct from b.v""")
def repo_diff_versions(spark, d):
    return (lambda repo, a, b: repo.diff(a, b))(*_two_versions(spark, d))


@query("select * from (values (0, 'load', 'orders', 'local', 'main', true, true, true), (1, 'batch', 'orders', 'local', 'main', false, false, true)) t(n, message, repo, remote, replica, first, no_prev, at_zero)")
def repo_history(spark, d):
    repo, first, _ = _two_versions(spark, d)
    return repo.history().select(F.col("n").cast("int").alias("n"), "message", "repo", "remote", "replica", (F.col("tip") == first).alias("first"), F.col("prev").isNull().alias("no_prev"), (F.col("ts") == 0).alias("at_zero"))


@query("select 'clean' as status, true as same, count(*) as n from orders where o_orderkey % 10 <> 7")
def repo_noop_commit(spark, d):
    """Committing the content that is there adds no version."""
    repo, _, second = _two_versions(spark, d)
    repo.change(repo.read().filter("v = 'U'").select("k", F.lit(maps.INSERT).alias("op"), "v"))
    repo.stage()
    same = repo.commit() == second and repo.history().count() == 2
    n = repo.read().filter("v <> 'N'").count()
    return spark.createDataFrame([(repo.status()["status"], same, n)], "status string, same boolean, n bigint")


_COUNTS = "select user_id::varchar as rid, count(*) as n from events {w} group by user_id"


def _counts(spark, d, where="true"):
    return table(spark, d, "events").filter(where).groupBy(F.col("user_id").alias("rid")).agg(F.count("*").alias("n"))


@query(f"select rid, 2 * n as n from ({_COUNTS.format(w='')})")
def container_commit(spark, d):
    """A counter committed twice and opened again."""
    engine = Engine.init(spark, f"{_folder(spark)}/repo")
    repo = ContainerRepo(engine, "hits", "g-counter")
    for _ in range(2):
        repo.add(_counts(spark, d))
        repo.commit()
    return ContainerRepo(engine, "hits", "g-counter").container.items.select(F.col("k").alias("rid"), F.col("v").cast("bigint").alias("n"))


@query(f"""
with a as ({_COUNTS.format(w="where event_type <> 'click'")}), b as ({_COUNTS.format(w="where event_type <> 'view'")})
select coalesce(a.rid, b.rid) as rid, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from a full join b on a.rid = b.rid""")
def replica_merge(spark, d):
    """Two replicas count apart; one takes in the other's by id, commits, and is opened again."""
    engine = Engine.init(spark, f"{_folder(spark)}/repo")
    for rid, where in (("one", "event_type <> 'click'"), ("two", "event_type <> 'view'")):
        repo = ContainerRepo(engine, "hits", "g-counter", rid)
        repo.add(_counts(spark, d, where))
        repo.commit()
    repo = ContainerRepo(engine, "hits", "g-counter", "one")
    repo.merge_replica("two")
    repo.commit()
    return ContainerRepo(engine, "hits", "g-counter", "one").container.items.select(F.col("k").alias("rid"), F.col("v").cast("bigint").alias("n"))


@query("select 'set' as kind, count(distinct v) as n from (select p_brand as v from part union all select p_type from part) union all select 'list', count(*) from part union all select 'pn-counter', sum(case when event_id % 3 = 0 then -1 else 1 end)::bigint from events union all select 'max-register', max(event_id) from events")
def container_kinds(spark, d):
    """Values of several kinds, saved and opened by id; sets, counters and registers merged by id."""
    engine = Engine.init(spark, f"{_folder(spark)}/repo")
    part, events = table(spark, d, "part"), table(spark, d, "events")
    made = {}
    for kind, rows, more in (
        ("set", part.select(F.col("p_brand").alias("value")), part.select(F.col("p_type").alias("value"))),
        ("pn-counter", events.filter("event_id % 3 = 0").select(F.lit("a").alias("rid"), F.lit(-1).alias("n")), events.filter("event_id % 3 <> 0").select(F.lit("b").alias("rid"), F.lit(1).alias("n"))),
        ("max-register", events.filter("event_id % 2 = 0").select(F.col("event_id").alias("n")), events.select(F.col("event_id").alias("n"))),
    ):
        one, two = Container(engine, kind), Container(engine, kind)
        one.add(rows)
        two.add(more)
        one.merge(two.save())
        made[kind] = Container(engine, kind, one.save())
    some = Container(engine, "list")
    some.add(part.select((F.col("p_partkey") - 1).alias("pos"), F.col("p_name").alias("value")))
    made["list"] = Container(engine, "list", some.save())
    rows = [(k, c.value() if k in ("pn-counter", "max-register") else c.items.count()) for k, c in made.items()]
    return spark.createDataFrame(rows, "kind string, n bigint")


@query("""
with m as (select 1 as kind, c_custkey as num, c_custkey::varchar as key, c_name as v from customer union all select 2, 0, c_name, c_custkey::varchar from customer)
select key, v, row_number() over (order by kind, num, key) as place from m""")
def container_typed_keys(spark, d):
    """Numbers and strings as keys of one map: numbers go by size, and before strings."""
    engine = Engine.init(spark, f"{_folder(spark)}/repo")
    c = table(spark, d, "customer")
    numbers = c.select(order_key(u32(F.col("c_custkey"))).alias("k"), F.col("c_name").alias("v"))
    names = c.select(order_key(text(F.col("c_name"))).alias("k"), F.col("c_custkey").cast("string").alias("v"))
    m = Container(engine, "map")
    m.add(numbers.unionByName(names).withColumn("op", F.lit(maps.INSERT)))
    items = Container(engine, "map", m.save()).items
    from lakecairn.operators.ranges import numbered

    placed = numbered(items, "k", "place")
    kind = F.substring("k", 1, 1).cast("int")
    key = F.when(kind == U32, F.expr("substring(k, 2)").cast("bigint").cast("string")).when(kind == STR, F.expr("substring(k, 2)"))
    return placed.select(key.alias("key"), "v", (F.col("place") + 1).alias("place"))


@query("select distinct sha256(text) as cid, octet_length(encode(text))::bigint as n_bytes from documents")
def store_put_read(spark, d):
    """All documents put twice, and read back by id."""
    store = ContentStore(spark, f"{_folder(spark)}/blobs")
    docs = table(spark, d, "documents")
    store.put(docs, "text")
    cids = store.put(docs, "text")
    found = store.read(cids, strict=True)
    return found.filter(hashing.content_id(F.col("bytes")) == F.col("cid")).select("cid", F.octet_length("bytes").cast("bigint").alias("n_bytes"))


@query("select distinct sha256(text) as cid from documents where source = 'src0'")
def store_exists(spark, d):
    """Which of all documents a store in memory has."""
    store = MemoryStore(spark)
    docs = table(spark, d, "documents")
    store.put(docs.filter("source = 'src0'"), "text")
    return store.exists(docs.select(hashing.content_id(F.col("text")).alias("cid")).distinct())


@query("with b as (select doc_id, source, sha256(text) as cid from documents) select doc_id, cid from b where cid in (select cid from b where source = 'src0')")
def exists_semi(spark, d):
    """Which of all documents a store on disk has."""
    store = ContentStore(spark, f"{_folder(spark)}/blobs")
    docs = table(spark, d, "documents")
    store.put(docs.filter("source = 'src0'"), "text")
    return store.exists(docs.select("doc_id", hashing.content_id(F.col("text")).alias("cid"))).select("doc_id", "cid")


@query("select count(*) as n, count(distinct cid) as n_cids, sum(octet_length(encode(html)))::bigint as n_bytes from (select html, sha256(html) as cid from pages)")
def store_blake2b(spark, d):
    """Pages under ids of another hash."""
    store = ContentStore(spark, f"{_folder(spark)}/blobs", lambda c: hashing.encode_base58(hashing.content_id_blake2b(c)))
    pages = table(spark, d, "pages").select(F.col("html").cast("binary").alias("bytes"))
    cids = store.put(pages)
    named = pages.withColumn("cid", store.name(F.col("bytes")))
    found = named.join(store.read(cids, strict=True).select("cid", F.octet_length("bytes").alias("n")), "cid")
    ok = hashing.id_ok(hashing.decode_base58(F.col("cid")))
    return found.filter(ok).agg(F.count("*").alias("n"), F.count_distinct("cid").alias("n_cids"), F.sum("n").cast("bigint").alias("n_bytes"))


for _name, _codec in (("records_json", None), ("records_delimited", DelimitedCodec())):

    @query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer", _name)
    def records(spark, d, codec=_codec):
        """Rows stored by content id and decoded again."""
        rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
        store = RecordStore(ContentStore(spark, f"{_folder(spark)}/blobs"), codec)
        cids = store.put(rows).select("cid").distinct()
        return store.read(cids, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string").drop("cid")


@query("select distinct 'sha256:' || sha256(text) as oid, octet_length(encode(text))::bigint as size from documents")
def lfs_write_read(spark, d):
    """Documents as large files: pointers first, then the bytes behind them."""
    folder = _folder(spark)
    files = LargeFileStore(ContentStore(spark, f"{folder}/blobs"), f"{folder}/index")
    pointers = files.write(table(spark, d, "documents"), "doc_id", "text", (256, 512, 1024))
    back = files.read_all(pointers.select("pointer.oid").distinct())
    return back.filter(hashing.lfs_oid(F.col("bytes")) == F.col("oid")).select("oid", F.octet_length("bytes").cast("bigint").alias("size"))


@query("select page_id as key, sha256(html) as cid from pages")
def lfs_clean_smudge(spark, d):
    """Pages to pointer texts and back."""
    folder = _folder(spark)
    files = LargeFileStore(ContentStore(spark, f"{folder}/blobs"), f"{folder}/index")
    texts = files.clean(table(spark, d, "pages"), "page_id", "html", sizes=(256, 512, 1024))
    return files.smudge(texts).select("key", hashing.content_id(F.col("bytes")).alias("cid"))


def _heads(spark, d):
    meta = MetaStore(spark, f"{_folder(spark)}/meta")
    e = table(spark, d, "events")
    meta.put_all(e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq")))
    meta.put("click/1", b"last")
    return meta


@query("select c_custkey::varchar as rid, case when c_custkey = 1 then 'last' else h end as head from customer left join (select user_id, max(event_id)::varchar as h from events where event_type = 'click' group by user_id) on user_id = c_custkey")
def meta_heads(spark, d):
    """Heads of replicas from a key store that was written in bulk and once more."""
    rids = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("rid"))
    return _heads(spark, d).heads("click", rids, strict=False)


@query("select distinct user_id::varchar as rid from events where event_type = 'click' union select '1'")
def meta_replicas(spark, d):
    return spark.createDataFrame([(r,) for r in _heads(spark, d).replicas("click")], "rid string")


@query("select 'last' as head, true as swapped, true as refused")
def meta_swap(spark, d):
    """A head goes on only from the one that was expected."""
    from lakecairn.errors import InUse

    meta = _heads(spark, d)
    before = meta.head("click", "1")
    meta.set_head("click", "1", "next", expected=before)
    try:
        meta.set_head("click", "1", "other", expected=before)
        refused = False
    except InUse:
        refused = True
    return spark.createDataFrame([(before, meta.head("click", "1") == "next", refused)], "head string, swapped boolean, refused boolean")


