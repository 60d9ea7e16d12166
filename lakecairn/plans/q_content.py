"""Queries on content ids, blob stores, chunks and rolling hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecairn.functions import hashing, rolling, values
from lakecairn.operators import chunking
from lakecairn.plans.registry import query, table
from lakecairn.sources.store import missing


@query("select doc_id, sha256(text) as cid, octet_length(encode(text))::bigint as n_bytes from documents")
def content_address(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_id(F.col("text")).alias("cid"), F.octet_length("text").cast("bigint").alias("n_bytes"))


_ESCAPED = r"replace(replace(replace(replace({c}, '\', '\\'), '|', '\|'), '=', '\='), ',', '\,')"


@query(f"select page_id, sha256('s' || {_ESCAPED.format(c='url')} || '|s' || {_ESCAPED.format(c='html')}) as cid from pages")
def put_cid(spark, d):
    return table(spark, d, "pages").select("page_id", hashing.content_id(values.encode_columns(F.col("url"), F.col("html"))).alias("cid"))


@query("select doc_id, '1' as version, 'sha256:' || sha256(text) as oid, octet_length(encode(text))::bigint as size from documents")
def lfs_pointer(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.lfs_pointer(F.col("text")).alias("p")).select("doc_id", "p.version", "p.oid", "p.size")


def _blobs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", hashing.content_id(F.col("text")).alias("cid"), F.octet_length("text").cast("bigint").alias("n_bytes"))


_BLOBS = "with b as (select doc_id, source, sha256(text) as cid, octet_length(encode(text))::bigint as n_bytes from documents) "


@query(_BLOBS + "select distinct cid, n_bytes from b where cid not in (select cid from b where source = 'src0')")
def dedup_insert(spark, d):
    """All documents put into a store that holds those of one source."""
    b = _blobs(spark, d)
    return missing(b, b.filter("source = 'src0'")).select("cid", "n_bytes")


@query(_BLOBS + "select count(*) as n_blobs, count(distinct cid) as n_cids, sum(n_bytes)::bigint as total_bytes, (select sum(n_bytes)::bigint from (select distinct cid, n_bytes from b)) as stored_bytes from b")
def dedup_stats(spark, d):
    by_cid = _blobs(spark, d).groupBy("cid").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"))
    return by_cid.agg(F.sum("n").alias("n_blobs"), F.count("*").alias("n_cids"), F.sum(F.col("n") * F.col("n_bytes")).alias("total_bytes"), F.sum("n_bytes").alias("stored_bytes"))


def _roll_sql(select: str) -> str:
    table_sql = ", ".join(f"({b}, {t}::bigint)" for b, t in enumerate(rolling.byte_table()))
    return f"""
with tab(b, t) as (values {table_sql}),
raw as (select doc_id, hex(encode(text)) as hx, octet_length(encode(text)) as n from documents),
bytes as (select doc_id, i as pos, ('0x' || substr(hx, (2 * i + 1)::bigint, 2))::int as b from (select doc_id, hx, unnest(range(n)) as i from raw)),
turned as (select doc_id, pos, bytes.b, (pos % 32)::int as k, t from bytes join tab on bytes.b = tab.b),
r as (select *, case when k = 0 then t else ((t >> k) | (t << (32 - k))) & 4294967295 end as r from turned),
p as (select *, bit_xor(r) over (partition by doc_id order by pos rows between unbounded preceding and current row) as p from r),
x as (select *, xor(p, coalesce(lag(p, {rolling.WINDOW}) over (partition by doc_id order by pos), 0::bigint)) as x from p),
h as (select doc_id, pos, b, ((x << k) | (x >> (32 - k))) & 4294967295 as h from x)
{select}"""


@query(_roll_sql("select doc_id, count(*) as n, max(h)::bigint as top, bit_xor(h)::bigint as mixed from h group by doc_id"))
def buzhash_roll(spark, d):
    return rolling.summary(table(spark, d, "documents"), "doc_id", "text")


@query(_roll_sql("select doc_id, pos::bigint as pos, h::bigint as h from h where h & 255 = 255"))
def chunk_boundaries(spark, d):
    return rolling.boundaries(table(spark, d, "documents"), "doc_id", "text", 8)


def _chunk_sql(least: int, mean: int, most: int) -> str:
    """Cuts by the rules of chunking.cut_points, from the rolling hash of every byte."""
    bits = max(1, (mean - least).bit_length() - 1)
    strict, loose = bits + 1, max(1, bits - 1)
    table_sql = ", ".join(f"({b}, {t}::bigint)" for b, t in enumerate(rolling.byte_table("chunk")))
    mark = "((h * 2654435761::hugeint) % 4294967296)::bigint"
    return f"""
with recursive tab(b, t) as (values {table_sql}),
raw as (select doc_id, text, hex(encode(text)) as hx, octet_length(encode(text)) as n from documents where text is not null),
bytes as (select doc_id, i as pos, ('0x' || substr(hx, (2 * i + 1)::bigint, 2))::int as b from (select doc_id, hx, unnest(range(n)) as i from raw)),
turned as (select doc_id, pos, (pos % 32)::int as k, t from bytes join tab on bytes.b = tab.b),
r as (select *, case when k = 0 then t else ((t >> k) | (t << (32 - k))) & 4294967295 end as r from turned),
p as (select *, bit_xor(r) over (partition by doc_id order by pos rows between unbounded preceding and current row) as p from r),
x as (select *, xor(p, coalesce(lag(p, {chunking.LOOK_BACK}) over (partition by doc_id order by pos), 0::bigint)) as x from p),
h as (select doc_id, pos + 1 as e, ((x << k) | (x >> (32 - k))) & 4294967295 as h from x),
ahead as materialized (select doc_id, e, min(case when {mark} >> {32 - strict} = 0 then e end) over w as s, min(case when {mark} >> {32 - loose} = 0 then e end) over w as l
    from h window w as (partition by doc_id order by e rows between current row and unbounded following)),
cuts(doc_id, pos, a, z, n) as (
    select doc_id, -1, 0::bigint, 0::bigint, n from raw
    union all
    select c.doc_id, c.pos + 1, c.z, case when s.s is not null and s.s <= least(c.z + {mean}, c.z + {most}, c.n) then s.s
        when l.l is not null and l.l < least(c.z + {most}, c.n) then l.l else least(c.z + {most}, c.n) end, c.n
    from cuts c left join ahead s on s.doc_id = c.doc_id and s.e = c.z + {least} left join ahead l on l.doc_id = c.doc_id and l.e = c.z + {mean}
    where c.z < c.n or (c.n = 0 and c.pos < 0)
)
select cuts.doc_id as key, pos, a as start, (z - a)::int as size, sha256(unhex(substr(hx, (2 * a + 1)::bigint, (2 * (z - a))::bigint))) as cid
from cuts join raw on raw.doc_id = cuts.doc_id where pos >= 0"""


@query(_chunk_sql(256, 512, 1024))
def cdc_chunks(spark, d):
    return chunking.index(chunking.chunks(table(spark, d, "documents"), "doc_id", "text", 256, 512, 1024))


@query("select doc_id, sha256(text) as cid, octet_length(encode(text))::bigint as n_bytes from documents")
def bytes_roundtrip(spark, d):
    cut = chunking.chunks(table(spark, d, "documents"), "doc_id", "text", 256, 512, 1024)
    back = chunking.assemble(chunking.index(cut), chunking.blobs(cut))
    return back.select(F.col("key").alias("doc_id"), hashing.content_id(F.col("bytes")).alias("cid"), F.octet_length("bytes").cast("bigint").alias("n_bytes"))
