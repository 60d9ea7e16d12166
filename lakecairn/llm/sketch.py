"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions alone.

A text's shingles are its runs of five words (a shorter text: all its words as one),
in lower case. Each gets a 64-bit hash, and the K smallest distinct hashes are the
sketch. Sketches of parts merge into the sketch of the whole: the K smallest of their
union. From two sketches follow resemblance, containment and numbers of shingles.

Defined cases: null counts as empty text; a text without words has an empty sketch;
two empty sketches are alike (1.0), an empty and another not at all (0.0); equal texts
have equal sketches; repeated ids are ordered by their text's hash; extra columns pass by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecairn.llm import graph

#: Hashes kept, and words of a shingle.
K, WORDS = 128, 5
#: Rows of an id range, and ranges at most: their table is broadcast.
RANGE_ROWS, MAX_RANGES = 500, 200_000
#: Times RANGE_ROWS (or the mean, where that is more) from which a range is cut again, and how often at most.
UNEVEN, CUTS = 4, 8

_SPAN = 2.0**64


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words in order; words are cut at white space (space, tab to carriage return)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct shingle hashes. ``hashes`` must be a column, not an expression: it is read per shingle."""
    n = F.size(hashes)
    long = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WORDS)]))
    short = F.when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= WORDS, long).otherwise(short))), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column."""
    return df.withColumn("_hashes", word_hashes(F.col(text))).withColumn(out, sketch_of(F.col("_hashes"), k)).drop("_hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, key: str, sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch a key from the sketches of its parts; a hot key is merged in ``salts`` pieces first."""
    value = F.explode(sketch).alias("h")
    least = lambda by: Window.partitionBy(*by).orderBy("h")
    rows = df.select(key, value).groupBy(key, "h").agg(F.lit(1).alias("_one")).withColumn("_salt", F.pmod("h", F.lit(salts)))
    some = rows.withColumn("_n", F.row_number().over(least([key, "_salt"]))).filter(F.col("_n") <= k)
    few = some.withColumn("_n", F.row_number().over(least([key]))).filter(F.col("_n") <= k)
    kept = few.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    keys = df.groupBy(key).agg(F.lit(1).alias("_one")).drop("_one")
    return keys.join(kept, keys[key].eqNullSafe(kept[key]), "left").select(keys[key], F.coalesce(sketch, F.array().cast("array<long>")).alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    kth = (F.element_at(sketch, k).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; exact while neither sketch is full."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal text."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def by_ranges(docs: DataFrame) -> DataFrame:
    """docs with ``own``, the number of a range of doc_id, in the order of ids (-1: no id).

    Ranges are of equal width at first; one with too many rows is cut again between its least and greatest id,
    so that ids far from the others, or close together, do not gather rows in one range.
    """
    found = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    count, low, high = found["n"], found["low"] or 0, found["high"] or 0
    ranges = max(1, min(MAX_RANGES, math.ceil(count / RANGE_ROWS)))
    most = max(RANGE_ROWS, math.ceil(count / ranges))
    from_low = F.col("doc_id") - F.lit(low) if high - low < 1 << 63 else F.col("doc_id").cast("double") - float(low)
    own = F.coalesce(F.floor(from_low / F.lit(float(max(1, math.ceil((high - low + 1) / ranges))))), F.lit(-1)).cast("long")
    docs = docs.withColumn("own", own)
    for _ in range(CUTS):
        each = docs.groupBy("own").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        heavy = (F.col("n") > UNEVEN * most) & (F.col("hi") > F.col("lo"))
        each, n_heavy = graph.counted(graph.few(each, 4 * MAX_RANGES), heavy)
        if not n_heavy:
            break
        pieces = F.when(heavy, F.ceil(F.col("n") / most)).otherwise(1).cast("long")
        width = F.floor((F.col("hi") - F.col("lo")) / pieces) + 1
        before = F.coalesce(F.sum(pieces).over(Window.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a table of one row a range
        table = each.select("own", "lo", width.alias("width"), before.alias("before"))
        docs = docs.join(F.broadcast(table), "own")
        named = F.col("before") + F.floor((F.col("doc_id") - F.col("lo")) / F.col("width"))
        docs = docs.withColumn("own", F.when(F.col("doc_id").isNull(), -1).otherwise(named).cast("long")).drop("lo", "width", "before")
    return docs


def with_next(docs: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """doc_id, text, each payload column, and of the row after it by doc_id (after the last: the first) next_<name>.

    Rows are dealt by ranges of doc_id. The first id of each range also goes, as a guard, to the end
    of the range before, so that every row finds the next one in its own range.
    """
    docs = by_ranges(docs.select("doc_id", "text"))
    firsts = docs.groupBy(F.col("own").alias("pid")).agg(F.min("doc_id").alias("first"))
    one = Window.orderBy("pid")  # a table of one row a range
    guards = firsts.withColumn("to", F.coalesce(F.lag("pid").over(one), F.max("pid").over(Window.partitionBy()))).select("first", "to")
    dealt = docs.join(F.broadcast(guards), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    where = F.explode(F.when(F.col("first").isNull() & F.col("to").isNull(), F.array(F.struct(F.col("own").alias("pid"), F.lit(False).alias("guard")))).otherwise(F.array(F.struct(F.col("own").alias("pid"), F.lit(False).alias("guard")), F.struct(F.col("to").alias("pid"), F.lit(True).alias("guard")))))
    rows = dealt.select(where.alias("at"), "doc_id", "text").select("at.pid", "at.guard", "doc_id", "text").repartition("pid")
    for name, col in payload.items():
        rows = rows.withColumn(name, col)
    order = Window.partitionBy("pid").orderBy("guard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    kept = [n for n in payload if not n.startswith("_")]
    for name in ("text", *kept):
        rows = rows.withColumn(f"next_{name}", F.lead(name).over(order))
    return rows.filter(~F.col("guard")).select("doc_id", "text", "next_text", *kept, *[f"next_{n}" for n in kept])


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness to each other and to the next text's.

    The edited text has its last quarter (in code points, rounded down) replaced by as much of the start of
    the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"_hashes": word_hashes(F.col("text")), "sketch": sketch_of(F.col("_hashes"), k)})
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_m", F.floor(n / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _m)"), F.expr("substring(next_text, 1, _m)"))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles_est"),
    )
