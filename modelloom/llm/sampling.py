"""Bounded samples of labelled documents, to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Of each sampled text, so many characters are learnt from.
MOST_CHARS = 1 << 16


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def sample(docs: DataFrame, labelled: DataFrame, label: str, most: int, most_chars: int = MOST_CHARS) -> list[tuple]:
    """(label, text), at most `most` documents of each label: those of the least hash of doc_id.

    labelled: doc_id and the label, only rows that may be learnt from. Of several labels of one doc_id, the least holds. A text
    counts with its first `most_chars` characters, which bounds what comes to the driver; scores are of whole texts all the same.
    """
    ids = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    # First within parts of a label, so that a label with most rows is no task of its own.
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))
    for by in (["_label", part], ["_label"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        ids = ids.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    ids = ids.select(F.col("doc_id").alias("_doc"), "_label", F.xxhash64("doc_id").alias("_order"))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_doc")).filter("text IS NOT NULL")
    rows = found.select("_label", F.substring("text", 1, most_chars).alias("text"), "_order", "doc_id").collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[2], r[3], r[1]))]
