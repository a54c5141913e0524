"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents, in an order set by a hash, are one stream of words, cut into blocks of
`block` words. Slot i of the schedule takes the point frac(i / golden ratio), which falls into one
source's share of the cumulative weights. A slot's rank among its source's slots picks the block:
a source that is taken more than once starts over after its last block. The sequence goes on somewhat
beyond what all sources need together; blocks that a source still lacks then (small shares are met
unevenly) get slots of their own after it, so that every source meets its target. Words past a source's target are not taken, so a source gives its
target, rounded to a word, and no document more than `most_times` its size.

Weights go to sources in code point order, null last. Targets share `share` times all sizes by
weight; what is above most_times a source's size is shared out among the others, until none is.

Ranks and running sums are taken in two steps, within bounded chunks and over the chunks' sums, so
that a source with a third of all rows is no task of its own. One row per source is what is ranked
in one place. Null text has no words: such a row takes part with size 0. Rows that repeat doc_id and
text are documents of their own. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.llm.common import SPACE, dropped, saved, words

WEIGHTS, SHARE, MOST_TIMES, BLOCK = (5.0, 2.0, 1.0), 1.5, 2.0, 64
#: Sources up to here are broadcast, some 60 bytes each.
MOST_SOURCES = 100_000
GOLDEN = (sqrt(5) - 1) / 2
_LOW = 1 << 26


def _step() -> float:
    """frac(_LOW * GOLDEN), by integers: _LOW * (sqrt(5) - 1) / 2 = (sqrt(5 * _LOW^2) - _LOW) / 2."""
    from math import isqrt

    scale = 1 << 60
    whole = (isqrt(5 * _LOW * _LOW * scale * scale) - _LOW * scale) // 2
    return (whole % scale) / scale


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """sizes: source, total. Adds sid (rank of the source, from 0), weight and target."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1)
    picks = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(picks, F.col("sid") % len(weights))).withColumn("cap", F.col("total") * F.lit(float(most_times)))
    # Capped are the sources that fill up first as the level (target / weight) rises.
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    goal = F.lit(float(share)) * F.sum("total").over(Window.partitionBy())
    level = (goal - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "sid", "level")))
    final = first.over(Window.partitionBy())["level"]
    return ranked.select("source", "sid", "total", "weight", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def _streams(base: DataFrame) -> DataFrame:
    """Adds start: the number of words before a row in its source's stream."""
    base = base.withColumn("bucket", F.shiftrightunsigned("o", 52))
    sums = base.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("sid", "bucket").orderBy("o", "doc_id", "size")
    base = base.withColumn("row", F.row_number().over(own)).withColumn("within", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return base.join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def schedule(sources: DataFrame, block: int = BLOCK, chunk: int = 1 << 14) -> DataFrame:
    """slot, sid, pass, k (block of the source's stream), use (words of it): exactly the slots that a source's target needs.

    Slots are in order, with gaps; those added for a source lie halfway between two points of the sequence.

    sources: sid, total, target.
    """
    spark = sources.sparkSession
    s = sources.filter("total > 0").withColumn("words", F.round("target").cast("long"))
    blocks = F.ceil(F.col("total") / block)
    full, rem = F.floor(F.col("words") / F.col("total")), F.col("words") % F.col("total")
    s = s.withColumn("blocks", blocks).withColumn("need", full * blocks + F.ceil(rem / block))
    upto = F.sum("need").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("upto", upto).withColumn("all", F.sum("need").over(Window.partitionBy()))
    s = saved(s.select("sid", "total", "words", "blocks", "need", ((F.col("upto") - F.col("need")) / F.col("all")).alias("lo"), (F.col("upto") / F.col("all")).alias("hi"), "all"), "shares")
    n_sources, n, scale = s.agg(F.count("*"), F.coalesce(F.max("all"), F.lit(0)).cast("long"), 2 * (F.coalesce(F.max("sid"), F.lit(0)) + 1)).first()
    i = F.col("slot")
    x = F.pmod((i % _LOW) * F.lit(GOLDEN) + F.floor(i / _LOW) * F.lit(_step()), F.lit(1.0))
    cells = 4096
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("x", x).withColumn("cell", F.floor(F.col("x") * cells).cast("int"))
    shares = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.floor(F.col("hi") * cells).cast("int"))))
    if n_sources <= MOST_SOURCES:
        shares = F.broadcast(shares)
    slots = slots.join(shares, "cell").filter("x >= lo AND x < hi").withColumn("chunk", F.floor(i / chunk))
    counts = saved(slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "counts")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("sid", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("rank", rank).join(counts, ["sid", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Ranks beyond a source's need aren't used; what it is short of is added. The m-th of several missing ones goes to m / several of the way.
    same = ["slot", "sid", "rank", "total", "words", "blocks"]
    ranked = ranked.filter("rank < need").withColumn("slot", scale * F.col("slot"))
    short = s.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
    way = F.floor((2 * (F.col("rank") - F.col("got")) + 1) * n / (2 * (F.col("need") - F.col("got"))))
    short = short.withColumn("slot", scale * way + scale // 2 + F.col("sid"))
    ranked = ranked.select(*same).unionByName(short.select(*same))
    # A source's blocks go by the order of its slots.
    chunked = ranked.withColumn("chunk", F.floor(F.col("slot") / (scale * chunk)))
    counts = saved(chunked.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "slots")
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot", "rank")) - 1
    ranked = chunked.withColumn("within", within).join(counts, ["sid", "chunk"]).withColumn("rank", F.col("within") + F.col("before"))
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("k", F.col("rank") % F.col("blocks"))
    left = F.col("words") - F.col("pass") * F.col("total") - F.col("k") * block
    use = F.least(left, F.lit(block), F.col("total") - F.col("k") * block)
    return ranked.withColumn("use", use).filter("use > 0").select("slot", "sid", "pass", "k", "use")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, pieces, sources). rows: one for each row of docs, with doc_id, size, source_size, target and its place (sid, bucket, row).
    pieces: the mix, one row for each slot and document: slot, pass, place, first (word of the document, from 0), words."""
    base = docs.select("doc_id", "source", F.size(words(F.col("text"), SPACE)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("o"))
    base = saved(base, "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("total"))
    sources = saved(targets(sizes, weights, share, most_times), "sources")
    few = sources.count() <= MOST_SOURCES
    by = sources.select("source", "sid", "total", "target")
    own = by.withColumnRenamed("source", "_source")
    rows = base.join(F.broadcast(own) if few else own, base.source.eqNullSafe(own["_source"])).drop("_source", "source")
    rows = saved(_streams(rows), "streams")
    dropped(base)
    slots = schedule(sources, block)
    parts = rows.filter("size > 0").select(
        "sid", "bucket", "row", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("k")
    )
    lo = F.greatest(F.col("start"), F.col("k") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("k") * block + F.col("use"))
    pieces = parts.join(slots, ["sid", "k"]).select("slot", "pass", "sid", "bucket", "row", "doc_id", (lo - F.col("start")).alias("first"), (hi - lo).alias("words")).filter("words > 0")
    return rows, pieces, F.broadcast(by) if few else by


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target (its source's), taken (words that the mix takes of it)."""
    rows, pieces, _ = mixed(docs, **options)
    taken = pieces.groupBy("sid", "bucket", "row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, ["sid", "bucket", "row"], "left").select("doc_id", "size", F.col("total").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns of docs: a row for each document and pass that takes any word of it.

    A document that is taken whole keeps its text; of another, the words taken, joined by a space. Rows that repeat source,
    doc_id and text differ by their other columns at most: by these, as JSON, they get the places that the mix gave them.
    """
    rows, pieces, sources = mixed(docs, **options)
    place, same = ["sid", "bucket", "row"], ["sid", "doc_id", "o"]
    rows = rows.select(*place, "doc_id", "o", "size")
    # docs in one column, so that no name of it can be one of ours.
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    base = base.join(sources.select("sid", F.col("source").alias("_source")), F.col("doc.source").eqNullSafe(F.col("_source"))).drop("_source")
    base = base.select("doc", "sid", F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc.doc_id", "doc.text").alias("o"))
    if rows.groupBy(*same).agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        rows, base = rows.withColumn("nth", F.lit(1)), base.withColumn("nth", F.lit(1))
    else:
        rest = [F.col(f"doc.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")]
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("bucket", "row")))
        base = base.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.to_json(F.struct(F.lit(0).alias("c"), *rest)))))
    spans = pieces.groupBy(*place, "pass").agg(F.min("first").alias("first"), F.sum("words").alias("n")).join(rows, place)
    spans = spans.select("sid", "o", "nth", F.col("doc_id").alias("id"), "first", "n", "size")
    met = base.join(spans, ["sid", "o", "nth"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
    part = F.array_join(F.slice(words(F.col("doc.text"), SPACE), (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ")
    met = met.withColumn("text", F.when(F.col("n") == F.col("size"), F.col("doc.text")).otherwise(part))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return met.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
