"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Rows of
one fingerprint are one class; classes link at `distance` or fewer differing bits.

Candidates: the 64 bits are cut into `segments` in a ring. If two fingerprints differ in d bits or
fewer, then from some segment on, the first l segments differ in l * d / segments bits or fewer, for
every l (the pigeonring principle). Chains of `chain` segments are indexed: for each start, and each
choice of the segments that may differ within those proportional budgets, the other segments are an
exact key. Fingerprints of one key are compared there: the chain's cumulative differences first, for
its whole length around the ring, and then all 64 bits.

No pairs are emitted within a group: of the fingerprints of a key, only as many links come out as
join them into the same components. A key with over `block` fingerprints is dealt out as pairs of
blocks, and a task holds a key at a time, so none gathers more than two blocks; the links between
blocks lose none of the components. Components come from the links of all keys.

Null and empty texts have no words: fingerprint zero, which links like any other. Rows that repeat
are members of one class. A component is named by its least doc_id (nulls aside; null if it has no
other). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.llm import textarrays as A
from modelloom.llm.common import saved
from modelloom.llm.components import components

SHINGLE, SEED, DISTANCE, SEGMENTS, CHAIN, BLOCK = 4, 42, 4, 9, 4, 4096


def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, how many each row has)."""
    start, end, row = A.word_spans(data, offsets)
    rows = len(offsets) - 1
    # Words at equal distances: one space after each, nothing else between.
    inside = (data != 32) & ((data < 9) | (data > 13))
    after = end[:-1][row[:-1] == row[1:]] if len(end) else end
    flat = np.where(inside, A.LOWER[data], np.uint8(32))
    flat[after] = 32
    keep = inside
    keep[after] = True
    moved = np.concatenate([[0], np.cumsum(keep)])
    start, end = moved[start], moved[end - 1] + 1 if len(end) else end
    raw = flat[keep].tobytes()
    n = np.bincount(row, minlength=rows)
    base = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.repeat(base[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = first + np.repeat(np.minimum(n, size), count) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(raw[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())), np.uint64, len(first))
    return hashes, count


#: For each byte, its bits as the lowest bits of 8 bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row, the bits that are set in over half of its hashes. Ones are counted 255 hashes at a time, a byte for each bit."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    n = count[has]
    parts = -(-n // 255)
    part_row = np.repeat(np.arange(len(n)), parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (np.cumsum(n) - n)[part_row] + 255 * nth
    row_at = np.cumsum(parts) - parts
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        ones = np.add.reduceat(_SPREAD[by_byte[:, byte]], at)
        ones = np.add.reduceat(ones.view(np.uint8).reshape(-1, 8).astype(np.int64), row_at, axis=0)
        more = (2 * ones > n[:, None]).astype(np.uint64)
        out[has] |= (more << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def _fingerprints(size: int, seed: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in A.chunks(b["text"]):
                hashes, count = _shingle_hashes(data, offsets, size, seed)
                out = _majority(hashes, count)
                part = b.slice(first, end - first)
                yield pa.record_batch([*(part[c] for c in keep), pa.array(out.view(np.int64))], names=[*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, fp (the fingerprint as a signed 64-bit integer)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, seed, ["doc_id"]), f"doc_id {id_type}, fp long")


def ring(segments: int) -> list[int]:
    """Bit masks of the segments, as even as can be."""
    ends = [64 * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]


def chain_masks(distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN) -> list[int]:
    """The bits of each exact key: a chain's segments but for those that may differ within the proportional budgets."""
    masks, budgets = ring(segments), [n * distance // segments for n in range(1, chain + 1)]
    fit = [set(x) for k in range(budgets[-1] + 1) for x in combinations(range(chain), k) if all(sum(i < n for i in x) <= budgets[n - 1] for n in range(1, chain + 1))]
    most = [x for x in fit if not any(x < y for y in fit)]
    return sorted({sum(masks[(s + i) % segments] for i in range(chain) if i not in x) for s in range(segments) for x in most})


def _fits_ring(x: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Whether, from some segment on, the cumulative differences around the whole ring stay within the budgets."""
    parts = np.stack([np.bitwise_count(x & np.uint64(m)) for m in ring(segments)], -1).astype(np.int64)
    budget = np.arange(1, segments + 1) * distance // segments
    return np.logical_or.reduce([(np.cumsum(np.roll(parts, -s, -1), -1) <= budget).all(-1) for s in range(segments)])


def _near(x: np.ndarray, distance: int, segments: int) -> np.ndarray:
    near = np.zeros(x.shape, bool)
    at = np.nonzero(np.bitwise_count(x) <= 4 * distance)  # far outside every budget
    at = tuple(a[_fits_ring(x[at], distance, segments)] for a in at)
    near[at] = np.bitwise_count(x[at]) <= distance
    return near


def _forest(fps: np.ndarray, distance: int, segments: int) -> tuple[list, list]:
    """Links that join the near ones of distinct fingerprints into the same components as all their links would."""
    a, b, rest = [], [], fps
    todo: list = []
    while len(rest) or todo:
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        now = todo.pop()
        near = _near(rest ^ now, distance, segments)
        found = rest[near]
        a += [now] * len(found)
        b += found.tolist()
        todo += list(found)
        rest = rest[~near]
        if not len(rest) and todo:
            break
    return a, b


def _links(distance: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a key are in one partition, sorted by key."""
        for table in A.whole_keys(batches):
            key, fp = table["key"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.diff(np.r_[first, len(key)])
            # Keys of a few fingerprints: all at once, those d apart in the order of their key.
            size, both = np.repeat(n, n), []
            for d in range(1, 16):
                at = np.flatnonzero((size[:-d] <= 16) & (key[d:] == key[:-d])) if len(key) > d else []
                if not len(at):
                    break
                at = at[_near(fp[at] ^ fp[at + d], distance, segments)]
                both.append((fp[at], fp[at + d]))
            for s, k in zip(first[n > 16], n[n > 16]):
                both.append(tuple(np.array(x, np.uint64) for x in _forest(np.unique(fp[s : s + k]), distance, segments)))
            a, b = (np.concatenate([x[i] for x in both] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
            if len(a):
                links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def near_links(classes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """classes: fp, distinct. Links a, b between fingerprints, all within the distance, with the same components as all such links."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in chain_masks(distance, segments, chain)])
    keys = classes.select("fp", F.posexplode(masks).alias("which", "mask"))
    keys = keys.select("fp", F.xxhash64("which", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    large = saved(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "large")
    if not large.isEmpty():
        hot = keys.join(large.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("n") / block))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        hot = hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        hot = hot.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
        keys = keys.join(large.hint("merge"), "key", "left_anti").select("fp", "key").unionByName(hot)
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance, segments), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, segments: int = SEGMENTS, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the least doc_id that links lead to, its own included)."""
    prints = saved(fingerprints(docs, shingle, seed), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(classes.select("fp"), distance, segments, chain, block))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = saved(named, "classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns: of each component the one with the least doc_id (see one_of_each)."""
    shingle, seed = options.pop("shingle", SHINGLE), options.pop("seed", SEED)
    prints = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = saved(prints.mapInArrow(_fingerprints(shingle, seed, ["doc_id", "th"]), f"doc_id {id_type}, th long, fp long"), "fingerprints")
    roots = components(near_links(prints.select("fp").distinct(), **options))
    return one_of_each(docs, prints.join(roots, prints["fp"] == roots["node"], "left").select("doc_id", "th", F.coalesce("root", "fp").alias("root")))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of the rows of docs, one for each root. groups: doc_id, th (xxhash64 of the text) and root, for each row of docs.

    The least doc_id stays, null after all others; of its texts, that of the least th. Rows that repeat both differ by other
    columns at most: the least of these stays. So rows that only share a doc_id, or have none, are told apart by their text."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keep = groups.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("rows")).select(F.col("k.doc_id").alias("_doc"), F.col("k.th").alias("_th"), "rows")
    keep = saved(keep, "keep")
    on = docs["doc_id"].eqNullSafe(keep["_doc"]) & (F.xxhash64(docs["text"]) == keep["_th"])
    # What stays grows with the documents: the join is the same one at every size, never a broadcast.
    out = docs.join(keep.select("_doc", "_th").hint("merge"), on, "left_semi")
    again = groups.groupBy("doc_id", "th").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return out
    # Rows that repeat doc_id and text are rare: only they need a look at each other.
    nth = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[c for c in docs.columns if c != "text"])
    return out.withColumn("_nth", F.row_number().over(nth)).filter("_nth = 1").drop("_nth")
