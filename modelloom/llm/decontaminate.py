"""Benchmark decontamination: a broadcast hash set of normalised test n-grams. DataFrame functions only.

Texts are lower-cased (A-Z) and cut into item words. An item's windows are its runs of `size` words;
an item of fewer words, but not none, is one window. The scan hashes every window of every document
and probes the broadcast set; a hit counts once its words are compared. Items are few and documents
many: the set is broadcast only as long as its measured size, words and item names included, is at
most `most_bytes`; beyond that, the same join is shuffled by hash, with the window's words beside it.

Null or empty text has no words and no hits. Items of a null id mark words but have no name to list.
Rows that repeat doc_id and text get the same result each; a doc_id with different texts is told
apart by their hash. Empty documents or an empty benchmark give no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm.common import NOT_ITEM_WORD, ascii_lower, words

WINDOW = 10
#: So many bytes of windows and item names at most go to each executor.
MOST_BYTES = 48 << 20


def _hashed(at: str, size: int):
    return F.xxhash64(*[F.get(F.col("words"), F.col(at) + k) for k in range(size)])


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each distinct window: len, h, window (its words), items (sorted distinct ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.col("text")), NOT_ITEM_WORD).alias("words"))
    items = items.withColumn("len", F.least(F.size("words"), F.lit(size))).filter("len > 0")
    runs = items.select("item", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("i"))
    runs = runs.select("item", "len", F.slice("words", F.col("i"), F.col("len")).alias("window"))
    return runs.groupBy("len", F.array_join("window", " ").alias("window")).agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every occurrence of an item's window: doc_id, key (hash of the text), at (first word, from 0), len, items."""
    windows = item_windows(benchmark, size)
    names = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x))
    own_bytes = F.sum(2 * F.octet_length("window") + 64 + names)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(own_bytes.alias("n")).collect()}  # at most `size` rows
    small = sum(sizes.values()) <= most_bytes
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), words(ascii_lower(F.col("text")), NOT_ITEM_WORD).alias("words"))
    out = None
    for n in sorted(sizes):
        own = windows.filter(F.col("len") == n).select("window", "items", F.split("window", " ").alias("words"))
        own = own.withColumn("zero", F.lit(0)).select(_hashed("zero", n).alias("h"), "window", "items")
        # A filter on the words, or the one that explode() implies, would cut every text into words once more.
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        at = base.select("doc_id", "key", "words", F.explode_outer(starts).alias("at")).filter("at IS NOT NULL").withColumn("h", _hashed("at", n))
        found = F.array_join(F.slice("words", F.col("at") + 1, F.lit(n)), " ")
        if small:
            met = at.join(F.broadcast(own), "h").filter(found == F.col("window"))
        else:
            met = at.select("doc_id", "key", "at", "h", found.alias("found")).join(own.hint("shuffle_merge"), "h").filter("found = window")
        met = met.select("doc_id", "key", "at", F.lit(n).alias("len"), "items")
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = base.filter(F.lit(False)).select("doc_id", "key", F.lit(0).alias("at"), F.lit(0).alias("len"), F.array(F.lit("")).alias("items"))
    return out


def _covered(spans):
    """Number of words inside any of the spans (at, len), sorted."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(acc, x):
        end = x["at"] + x["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["at"]))).cast("long").alias("n"),
            F.greatest(acc["end"], end).cast("long").alias("end"),
        )

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, key, n_words, n_hit, items (sorted), spans (at, len)."""
    found = hits(docs, benchmark, size, most_bytes)
    per = found.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    per = per.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "spans", "items", _covered(F.col("spans")).alias("n_hit"))
    count = F.size(words(ascii_lower(F.col("text")), NOT_ITEM_WORD)).cast("long")
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), count.alias("n_words"))
    none = F.array().cast("array<string>")
    return base.join(per, base.doc_id.eqNullSafe(per["_doc"]) & (base.key == per["_key"]), "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), "spans"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs, all columns, without those in which a window of an item occurs."""
    bad = hits(docs, benchmark, size, most_bytes).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")
