from __future__ import annotations

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"

#: Rows that every operator on documents must take: nulls, empty, repeats, long, odd characters.
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "s", 0, None),
    (3, " \n\t ", "en", "s", 4, "x"),
    (4, "one", "en", "s", 3, "x"),
    (5, "one", "en", "s", 3, "x"),
    (6, "The same words, again and again and again and again.\n" * 40, "en", "s", 0, "x"),
    (7, "The same words, again and again and again and again.\n" * 40, "de", "s", 0, "x"),
    (8, "ΣΑΣ İstanbul ﬀ é 日本語 \U0001f642 12 !!", "en", "s", 0, "x"),
    (9, "12 !! ??", "en", "s", 0, "x"),
    (10, "word " * 60000, "en", "s", 0, "x"),
    (None, "no id here at all", "en", "s", 0, "x"),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
