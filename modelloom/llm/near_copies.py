"""Near copies by exact similarity of word shingles: every pair at `similarity` or more links, and no other.

A row's set holds the 64-bit hashes of its runs of `size` words (words are what ASCII white space
leaves, A-Z lower-cased; a row of fewer words has one run, of all). Similarity is Jaccard's, of the
sets. Rows of equal sets are one class, named by a 64-bit sum over its set.

Candidates come from a prefix filter, which loses no pair: with all sets in one order, two that are
similar enough share one of their first n - ceil(similarity * n) + 1 hashes, and the first hash that
they share leaves enough behind it in both. The order is that of the hashes, but for those that a
sample has seen often (a common line, a licence), which come last. The order decides how many
candidates there are, never which pairs link.

Of the classes that share a hash of their prefixes, one is the hash's centre, and first each meets the
centres of its hashes. This is done up to ROUNDS times, with other centres, for hashes of three
classes or more that the links found so far leave in different components, so that what is left of a
large group is few. Then all its pairs in different components meet; a hash with over `block` classes
is dealt out as pairs of blocks. Before two sets are fetched and compared, their sketches are: how many hashes fall into each
of SEGMENTS segments of the hash range. Segment by segment the sets differ by as much as their counts
do at least, so pairs whose differences add up beyond the budget go, and no other.

Null and empty texts have the empty set, and are copies of each other. Rows that repeat are members
of one class. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm import simhash
from modelloom.llm import textarrays as A
from modelloom.llm.common import dropped, released, saved
from modelloom.llm.components import components

SIZE, SIMILARITY, BLOCK, SEGMENTS, ROUNDS = 5, 0.8, 4096, 128, 2
#: Texts to fetch are picked by a broadcast of their keys up to here (some 40 bytes each), by a shuffled join beyond.
MOST_BROADCAST = 500_000
#: One text of so many is looked at for common hashes; those in `OFTEN` of them come last, up to MOST_OFTEN of them.
ONE_OF, OFTEN, MOST_OFTEN = 16, 4, 100_000
_EPS = 1e-9


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct hashes of each row, rows in order, and the row of each)."""
    data = A.LOWER[data]
    start, end, row = A.word_spans(data, offsets)
    words = A.word_hashes(data, start, end)
    n = np.bincount(row, minlength=len(offsets) - 1)
    hashes, rows = [], []
    for k in range(1, size + 1):
        runs = A.run_hashes(words, k)
        own = row[: len(runs)]
        at = np.flatnonzero((own == row[k - 1 : k - 1 + len(runs)]) & ((n[own] == k) if k < size else True))
        hashes.append(runs[at])
        rows.append(own[at])
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"]):
                h, r = shingle_sets(data, offsets, size)
                ends = np.searchsorted(r, np.arange(stop - first + 1))
                yield pa.record_batch([b["sig"].slice(first, stop - first), A.lists(h.view(np.int64), ends)], names=["sig", "hashes"])

    return run


def _singles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in A.chunks(b["text"]):
                yield pa.record_batch([pa.array(shingle_sets(data, offsets, size)[0].view(np.int64))], names=["h"])

    return run


def _least_overlap(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return similarity / (1 + similarity) * (n + m) - _EPS


def _prints(size: int, similarity: float, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(int.from_bytes(os.urandom(16), "little"))
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"]):
                rows = stop - first
                h, r = shingle_sets(data, offsets, size)
                n = np.bincount(r, minlength=rows)
                sums = np.concatenate([np.zeros(1, A.U64), np.cumsum(A.mixed(h))])
                ends = np.concatenate([[0], np.cumsum(n)])
                sig = A.mixed(sums[ends[1:]] - sums[ends[:-1]] + n.astype(A.U64))
                fp = simhash._majority(h, n)
                if len(often) and len(h):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    h = h[np.lexsort((h, often[at] == h, r))]
                long = np.where(n > 0, n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1, 0)
                keep = np.arange(len(h)) - ends[r] < long[r]
                part = b.slice(first, rows)
                uid = rng.integers(0, 1 << 63, rows, np.int64)
                prefix = A.lists(h[keep].view(np.int64), np.concatenate([[0], np.cumsum(long)]))
                segment = (h >> A.U64(57)).astype(np.int64) + r * SEGMENTS
                counts = np.minimum(np.bincount(segment, minlength=rows * SEGMENTS), 255).astype(np.uint8)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SEGMENTS), rows, [None, pa.py_buffer(counts)]).cast(pa.binary())
                yield pa.record_batch([part["doc_id"], part["th"], pa.array(uid), pa.array(sig.view(np.int64)), pa.array(n.astype(np.int64)), prefix, sketch, pa.array(fp.view(np.int64))], names=["doc_id", "th", "uid", "sig", "n", "prefix", "sketch", "fp"])

    return run


def _can_be(n, rank, m, rank_m, similarity: float):
    """Whether sets of n and m hashes that share a first one at these ranks can be similar enough (columns)."""
    return F.least(n - rank, m - rank_m) >= F.lit(similarity / (1 + similarity)) * (n + m) - _EPS


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SEGMENTS).astype(np.int16)


def _candidates(similarity: float):
    """Pairs a < b of classes of a key that can be similar enough, by their sketches too, and are in different components. No other pair leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in A.whole_keys(batches):
            key, sig, n, rank, root = (table[c].to_numpy() for c in ("key", "sig", "n", "rank", "root"))
            sketch = _sketch_rows(table["sketch"])
            d, at = 1, np.arange(len(key))
            while len(at):
                at = at[at + d < len(key)]
                at = at[key[at] == key[at + d]]
                x, y = at, at + d
                fit = (sig[x] != sig[y]) & (root[x] != root[y])
                fit &= np.minimum(n[x] - rank[x], n[y] - rank[y]) >= _least_overlap(n[x], n[y], similarity)
                x, y = x[fit], y[fit]
                fit = np.abs(sketch[x] - sketch[y]).sum(1) <= n[x] + n[y] - 2 * _least_overlap(n[x], n[y], similarity)
                a, b = sig[x[fit]], sig[y[fit]]
                if len(a):
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                d += 1

    return run


def _sketched(similarity: float):
    """Only pairs whose sketches leave room for enough overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _sketch_rows(b["sa"]), _sketch_rows(b["sb"])
            n, m = b["na"].to_numpy(), b["nb"].to_numpy()
            apart = np.abs(x - y).sum(1)
            keep = apart <= n + m - 2 * _least_overlap(n, m, similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _dealt(keys: DataFrame, block: int) -> DataFrame:
    """keys with many, the classes of each: those over block as pairs of blocks, each a key of its own."""
    blocks = F.ceil(F.col("many") / block)
    own = F.pmod(F.xxhash64("sig"), blocks)
    keys = keys.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pair = F.when(F.col("many") <= block, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return keys.withColumn("key", pair).drop("own", "other")


def _centres(keys: DataFrame, seed: int, *more) -> DataFrame:
    """key and its centre's columns, by another order for each seed; picked in four ways, so that all hashes of a class don't agree on one that is like few others."""
    order = F.xxhash64("sig", F.col("key").bitwiseAND(3), F.lit(seed))
    own = [c for c in ("sig", "n", "rank", "root") if c in keys.columns]
    heads = keys.groupBy("key").agg(*more, F.min(F.struct(order, *own)).alias("c"))
    return heads.select("key", *(["many"] if more else []), *[F.col(f"c.{c}").alias(f"c_{c}") for c in own])


def often(docs: DataFrame, size: int = SIZE, one_of: int = ONE_OF, at_least: int = OFTEN, most: int = MOST_OFTEN) -> np.ndarray:
    """Hashes that a sample of the distinct texts has often, sorted."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0).distinct()
    seen = some.mapInArrow(_singles(size), "h long").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= at_least)
    got = [r.h for r in seen.orderBy(F.desc("c"), "h").limit(most).collect()]
    return np.sort(np.array(got, np.int64).view(A.U64))


def like_prints(classes: DataFrame, distance: int = simhash.DISTANCE, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of classes (sig, fp) that links of their fingerprints lead through: of equal fingerprints, one class meets the others."""
    heads = saved(classes.groupBy("fp").agg(F.min("sig").alias("head"), F.count("*").alias("many")), "heads")
    same = classes.join(heads.filter("many > 1").select("fp", "head").hint("merge"), "fp").filter("sig != head").select("head", "sig")
    of = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias("s" + x)).hint("merge")
    met = simhash.near_links(heads.select("fp"), distance, block=block).distinct().join(of("a"), "a").join(of("b"), "b").select("sa", "sb")
    return met.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, block: int = BLOCK, most_broadcast: int = MOST_BROADCAST, distance: int = simhash.DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, th (the XXH64 of its text), root (the same for all rows that links lead to)."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    common = often(docs, size)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    prints = base.mapInArrow(_prints(size, similarity, common), f"doc_id {id_type}, th long, uid long, sig long, n long, prefix array<long>, sketch binary, fp long")
    prints = saved(prints, "prints")
    rows = saved(prints.select("doc_id", "th", "uid", "sig"), "rows")
    # One row stands for each class.
    first = saved(prints.groupBy("sig").agg(F.min("uid").alias("uid")).select("uid"), "firsts")
    one = prints.join(first.hint("merge"), "uid", "left_semi")
    sketches = saved(one.select("sig", "n", "sketch", "fp"), "sketches")
    keys = one.select("sig", "n", F.posexplode("prefix").alias("rank", "key")).withColumn("rank", F.col("rank").cast("long")).repartition("key")
    heads = _centres(keys, 0, F.count("*").alias("many")).filter("many > 1")
    shared = saved(keys.join(heads.hint("merge"), "key"), "shared")
    dropped(prints)
    released(spark)

    def sketched(candidates: DataFrame) -> DataFrame:
        of = lambda x: sketches.select(F.col("sig").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)).hint("merge")
        pairs = candidates.distinct().join(of("a"), "a").join(of("b"), "b")
        return pairs.mapInArrow(_sketched(similarity), "a long, b long")

    def links(candidates: DataFrame) -> DataFrame:
        pairs = saved(candidates, "pairs")
        wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(rows.hint("merge"), "sig").join(first.hint("merge"), "uid", "left_semi")
        wanted = saved(wanted.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "sig"), "wanted")
        pick = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted.hint("merge")
        texts = base.join(pick, base["th"].eqNullSafe(F.col("_th")) & base["doc_id"].eqNullSafe(F.col("_doc")))
        sets = saved(texts.select("sig", "text").dropDuplicates(["sig"]).mapInArrow(_sets(size), "sig long, hashes array<long>"), "sets")
        released(spark)
        met = pairs.join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("hb")).hint("merge"), "b")
        met = met.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("ha")).hint("merge"), "a")
        both = F.size(F.array_intersect("ha", "hb"))
        near = both * (1 + similarity) >= F.lit(similarity) * (F.size("ha") + F.size("hb")) - _EPS
        out = saved(met.filter(near).select("a", "b"), "near")
        dropped(sets, pairs, wanted)
        released(spark)
        return out

    near = links(sketched(like_prints(sketches.select("sig", "fp"), distance, block)))
    roots = components(near)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that the links found so far leave in different components."""
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias("r" + x)).hint("merge")
        met = pairs.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
        return met.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    fits = (F.col("sig") != F.col("c_sig")) & _can_be(F.col("n"), F.col("rank"), F.col("c_n"), F.col("c_rank"), similarity)
    pair = [F.least("sig", "c_sig").alias("a"), F.greatest("sig", "c_sig").alias("b")]
    near = near.unionByName(links(sketched(apart(shared.filter(fits).select(*pair)))))
    roots = components(near)
    left = shared.filter("many > 2").select("key", "many", "sig", "n", "rank")

    def open_(left: DataFrame) -> DataFrame:
        """What is left: hashes whose classes are in different components, with the root of each class."""
        now = left.join(roots.hint("merge"), left["sig"] == roots["node"], "left").withColumn("root", F.coalesce("root", "sig")).drop("node")
        keys = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
        return saved(now.join(keys.hint("merge"), "key"), "open")

    more = open_(left)
    dropped(shared)
    for seed in range(1, ROUNDS):
        if more.isEmpty():
            break
        met = more.join(_centres(more, seed).hint("merge"), "key").filter(fits & (F.col("root") != F.col("c_root")))
        found = links(sketched(met.select(*pair)))
        if found.isEmpty():
            break
        near = near.unionByName(found)
        roots = components(near)
        old, more = more, open_(more.drop("root"))
        dropped(old)
    if not more.isEmpty():
        # Block pairs of one component give nothing: the roots differ or the pair is left out.
        met = more.join(sketches.select("sig", "sketch").hint("merge"), "sig")
        met = _dealt(met, block).repartition("key").sortWithinPartitions("key")
        near = near.unionByName(links(met.mapInArrow(_candidates(similarity), "a long, b long").distinct()))
        roots = components(near)
    dropped(more, sketches, first)
    return rows.join(roots.hint("merge"), rows["sig"] == roots["node"], "left").select("doc_id", "th", F.coalesce("root", "sig").alias("root"))
