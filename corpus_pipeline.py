"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads what the one before wrote and returns the columns of documents, the
last one tokens. Null ids are kept where a stage has no verdict on them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecairn.llm import bpe, graph, jaccard, langid, mixing, suffix
from lakecairn.llm import textkernel as K

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those whose ids are given; the ids are broadcast only while they are few."""
    ids, n = graph.counted(ids.filter("doc_id is not null").distinct())
    return docs.join(graph.small(ids, n), "doc_id", "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language go: no text, no letter in it, or no language's codeword near."""
    found = langid.predict(docs, langid.train(docs.filter(~langid.held_out())), carry=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != "und") & (F.col("distance") < langid.FAR)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    groups, repeated = jaccard.join_rows(docs)
    kept = _without(docs, groups.filter("doc_id <> component_id").select("doc_id"))
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go; a character that was cut through goes whole; documents left empty by it go."""
    known = docs.filter("doc_id is not null")
    out = suffix.dedup(known, text=True, carry=("lang", "source")).filter("n_removed = 0 or n_removed < n_bytes")
    return _decoded(out).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def _decoded(cut: DataFrame) -> DataFrame:
    """Kept bytes as text: what is left of a character at either end of a cut is no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            cols = {c: batch.column(c) for c in ("doc_id", "lang", "source")}
            yield pa.record_batch(cols | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return cut.select("doc_id", "kept", "lang", "source").mapInArrow(K.tidy(run), "doc_id long, lang string, source string, text string, n_chars long").select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay once or go, by rates that op8's descent, projected to 0..1, fits to the weights as shares of the kept tokens."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train(docs, mixing.label_domains(labels))
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    soft = graph.checkpointed(mixing.posteriors(keyed.select(F.col("row").alias("doc_id"), "text"), model))
    rated = mixing.rates(soft, mixing.select(soft, model.domains, mixing.WEIGHTS))
    gone, n = graph.counted(rated.filter(mixing.copies(F.col("rate")) < 1).select(F.col("doc_id").alias("row")).distinct())
    return keyed.join(graph.small(gone, n), "row", "left_anti").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of the decoded text."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing_to_weights),
    ("bpe", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    folder = f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Classifiers, suffix refinement and merging by rank are not SQL: tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
