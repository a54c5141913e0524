"""Exact dedup by deterministic block naming. DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted into
integer names; then adjacent names are paired, and distinct pairs named in turn, until one name is
left of each document. Two documents have the same (level, name) exactly if their texts are equal.

The contents of blocks are shuffled once. From then on a block goes by its 64-bit hash; where two
different blocks share a hash (seen exactly, as the least and the greatest block of a hash differ),
their contents stay part of the key, so names never collide.

Null text is the empty text, which is one empty block. Rows that repeat both doc_id and text are
documents of their own: each counts in group_size, and one of them is kept. A null doc_id is less
than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelloom.llm.common import ascii_lower, dropped, named, saved

BLOCK_BYTES = 8192


def _blocks(docs: DataFrame, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """doc_id, sha, n (blocks), i, h, block."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    base = docs.select("doc_id", text.cast("binary").alias("bytes"))
    base = base.withColumn("n", F.greatest(F.ceil(F.length("bytes") / block_bytes), F.lit(1)).cast("int"))
    return (
        base.withColumn("sha", F.sha2("bytes", 256))
        .select("doc_id", "sha", "n", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        .withColumn("block", F.substring("bytes", F.col("i") * block_bytes + 1, F.lit(block_bytes)))
        .select("doc_id", "sha", "n", "i", block_hash(F.col("block")).alias("h"), "block")
    )


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, sha (of the normalised text), copies (equal rows), level, name: one row for each doc_id and text."""
    blocks = _blocks(docs, block_bytes, block_hash)
    ends = blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    hashes = saved(ends.select("h", (F.col("lo") != F.col("hi")).alias("clash")), "hashes")
    alone = hashes.filter(~F.col("clash")).select("h", F.lit(None).cast("binary").alias("block"))
    clash = hashes.filter("clash").select("h")
    clashes = not clash.isEmpty()
    if clashes:
        shared = blocks.join(clash, "h", "left_semi").select("h", "block").distinct()
        names = saved(named(alone.unionByName(shared), ["h", "block"]), "names")
        both = blocks.join(clash.withColumn("c", F.lit(True)), "h", "left").withColumn("block", F.when(F.col("c"), F.col("block")))
        on = names.withColumnRenamed("h", "h2").withColumnRenamed("block", "block2")
        first = both.join(on, (both.h == on.h2) & both.block.eqNullSafe(on.block2))
    else:
        names = saved(named(alone.select("h"), ["h"]), "names")
        first = blocks.select("doc_id", "sha", "n", "i", "h").join(names, "h")
    now = saved(first.groupBy("doc_id", "sha", "n", "i").agg(F.first("name").alias("name"), F.count("*").alias("copies")), "level0")
    dropped(hashes, names)

    level, ready, old = 0, [], [now]
    while True:
        done = now.filter("n = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name")
        ready.append(done)
        rest = now.filter("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("doc_id", "sha", "n", "copies", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        names = named(pairs.select("a", "b").distinct(), ["a", "b"])
        level += 1
        now = saved(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "copies", F.shiftright(F.col("n") + 1, 1).alias("n"), "i", "name"), f"level{level}")
        old.append(now)
    out = ready[0]
    for x in ready[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the greatest doc_id stays."""
    ids = identities(docs, block_bytes, block_hash)
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = saved(groups, "groups")  # a row for each identity, so that the join back is one that Spark splits where a group is hot
    return (
        ids.join(groups, ["level", "name"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )
