"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecairn.llm import bpe, extract, jaccard, langid, mixing, quality, rules, sketch, suffix, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(_documents(spark, sf_dir))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "lang_second")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.verdicts(_documents(spark, sf_dir), rules.POLICIES["web", 1])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~langid.held_out()))
    out = quality.score(docs, model).withColumn("held_out", langid.held_out())
    return out.select("doc_id", "held_out", "score", "predicted")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out, fit = mixing.mix(_documents(spark, sf_dir), mixing.label_domains(labels), mixing.WEIGHTS)
    return out.withColumn("copies", mixing.copies(F.col("rate"))).withColumn("miss", F.lit(fit.miss))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_documents(spark, sf_dir))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_html_extraction": op7_html_extraction,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
), s as (
    select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle
    from w
), n as (
    select doc_id, count(*) as n from s group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), reached(node, origin) as (
    select doc_id, doc_id from documents
    union
    select l.b, r.origin from reached r join links l on l.a = r.node
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.component_id, coalesce(l.n_links, 0)::bigint as n_links
from documents d left join n on n.doc_id = d.doc_id
join (select node, min(origin) as component_id from reached group by node) r on r.node = d.doc_id
left join (select a, count(*) as n_links from links group by a) l on l.a = d.doc_id
""",
    "op10_suffix_dedup": r"""
with t as (
    select doc_id, hex(encode(coalesce(text, ''))) as hx from documents
), w as (
    select doc_id, i, md5_number(substr(hx, 2 * i + 1, 200)) as h
    from (select doc_id, hx, unnest(range(0, length(hx) // 2 - 99)) as i from t where length(hx) >= 200)
), late as (
    select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as r from w) where r > 1
), marked as (
    select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from late
), numbered as (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from marked
), spans as (
    select doc_id, span, min(i) as a, max(i) + 100 as b from numbered group by doc_id, span
), gaps as (
    select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from spans
    union all select t.doc_id, coalesce(x.b, 0), length(hx) // 2 from t left join (select doc_id, max(b) as b from spans group by doc_id) x on x.doc_id = t.doc_id
), kept as (
    select g.doc_id, string_agg(substr(hx, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a, g.b) as hx from gaps g join t on t.doc_id = g.doc_id group by g.doc_id
)
select t.doc_id, (length(t.hx) // 2)::bigint as n_bytes, ((length(t.hx) - length(k.hx)) // 2)::bigint as n_removed,
    coalesce(c.n, 0)::bigint as n_spans, sha256(unhex(k.hx)) as kept_sha256
from t join kept k on k.doc_id = t.doc_id left join (select doc_id, count(*) as n from spans group by doc_id) c on c.doc_id = t.doc_id
""",
    "op5_quality_rules": r"""
with t as (
    select doc_id, coalesce(text, '') as text from documents
), w as (
    select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from t
), three as (
    select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3
), seen as (
    select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from three
), covered as (
    select doc_id, count(distinct i + k) as n_repeat_words
    from seen, (values (0), (1), (2)) as o(k) where n > 1 group by doc_id
), m as (
    select w.doc_id, len(words)::bigint as n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(lines) as n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
        length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) as n_letters,
        coalesce(list_max(list_transform(words, lambda x: length(x))), 0) as longest_word
    from w left join covered on w.doc_id = covered.doc_id
), bits as (
    select *,
        (case when n_words < 50 then 1 else 0 end)
        + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
        + (case when 100 * n_symbols > 10 * word_chars then 4 else 0 end)
        + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
        + (case when 100 * n_upper > 50 * n_letters then 16 else 0 end)
        + (case when 100 * n_letters < 50 * word_chars then 32 else 0 end)
        + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 64 else 0 end)
        + (case when longest_word > 1000 then 128 else 0 end) as failed
    from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    failed & 3 <> 0 as base_failed, failed & 23 = 0 as kept, failed::bigint as failed
from bits
""",
}
