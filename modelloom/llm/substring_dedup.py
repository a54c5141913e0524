"""Substring dedup by level-wise doubling.

A word goes if a window of `window` words that covers it starts anywhere else too. The lengths double
up to the window (9, 18, 35 for 35), and only what is repeated at one length is extended to the next.

Level 1, the shortest length: of the runs of that length inside each window, the one of least hash is
its anchor (the first of equals, so equal windows have equal anchors at equal places). Anchors that
occur once die, and with them all their windows. What survives is first looked at as a whole: the
reach of an anchor is all its windows together. Occurrences of one reach are a class. A class with
two or more members is settled, as all its windows are repeated. A class of one is open if its anchor
is in other classes too; those go on, with one member of each class beside them.

Levels 2 and on: each open anchor's windows are covered by runs of the level's length, and only
windows whose run occurs in two classes or more go on, until the length is the window's or no
candidate is left.

Hashes of 64 bits choose anchors, so that a collision costs work only. Whether a reach or a run is
the same is told by the 128-bit BLAKE2 digest of its words.

A hot anchor is no task of its own: counts are partial sums, one row stands for a class, and the
joins back to the occurrences are sort-merge joins that Spark splits where they are skewed.

Null text is no words; a text of fewer words than the window keeps all. Rows that repeat doc_id and
text are documents of their own, so they repeat each other. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm import textarrays as A
from modelloom.llm.common import dropped, released, saved

WINDOW, SHORTEST = 35, 9


def lengths(window: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths of the levels, up to the window: each at least half of the next."""
    out = [window, (window + 1) // 2]
    while out[-1] > shortest:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _digests(raw: bytes, start: list[int], end: list[int]) -> np.ndarray:
    """The 128-bit digest of each part of raw, as two columns."""
    h = hashlib.blake2b
    return np.frombuffer(b"".join([h(raw[a:b], digest_size=16).digest() for a, b in zip(start, end)]), np.int64).reshape(-1, 2)


def _packed(at: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An anchor's place as one number: its word in the document, the words of its reach before it, its windows."""
    return at << 16 | back << 8 | n


def _unpacked(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 16, pack >> 8 & 255, pack & 255


def _read(window: int, shortest: int):
    """Each row's number of words, the hash of all its words joined by a space, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"]):
                start, end, row = A.word_spans(data, offsets)
                n = np.bincount(row, minlength=stop - first)
                base = np.concatenate([[0], np.cumsum(n)])
                grams = A.run_hashes(A.word_hashes(data, start, end), shortest)
                at = A.least_of(grams, window - shortest + 1)
                w = np.flatnonzero(row[: len(at)] == row[window - 1 : window - 1 + len(at)])  # windows inside one row
                at = at[w]
                new = np.ones(len(at) + 1, bool)
                new[1:-1] = at[1:] != at[:-1]
                edges = np.flatnonzero(new)
                lo, last, at = w[edges[:-1]], w[edges[1:] - 1], at[edges[:-1]]
                own = row[at]
                raw, start, end = A.spaced(data, start, end)
                raw = raw.tobytes()
                digest = _digests(raw, start[lo].tolist(), end[last + window - 1].tolist())
                heads, tails = np.append(start, 0)[base[:-1]].tolist(), np.append(0, end)[base[1:]].tolist()
                sha = [hashlib.sha256(raw[x:y] if k else b"").hexdigest() for x, y, k in zip(heads, tails, n.tolist())]
                count = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=stop - first))])
                part = b.slice(first, stop - first)
                arrays = [_packed(at - base[own], at - lo, last - lo + 1), grams[at].view(np.int64), digest[:, 0], digest[:, 1]]
                yield pa.record_batch(
                    [part["doc_id"], part["key"], pa.array(n.astype(np.int64)), pa.array(sha, pa.string()), *(A.lists(x, count) for x in arrays)],
                    names=["doc_id", "key", "n_words", "sha", "pack", "gram", "d1", "d2"],
                )

    return run


def _extended(window: int, levels: list[int]):
    """A row for each open anchor, with its runs of each level's length: the k-th starts k * step words before the anchor, k from least on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b["marks"]
            ends = np.asarray(marks.offsets, np.int64)
            pack, kind = (x.to_numpy(zero_copy_only=False) for x in marks.values.flatten())
            for first, stop, data, offsets in A.chunks(b["text"]):
                lo = ends[first]
                pick = lo + np.flatnonzero(kind[lo : ends[stop]] > 0)
                if not len(pick):
                    continue
                start, end, row = A.word_spans(data, offsets)
                base = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=stop - first))])
                raw, start, end = A.spaced(data, start, end)
                raw = raw.tobytes()
                own = np.searchsorted(ends[first : stop + 1], pick, "right") - 1
                at, back, n = _unpacked(pack[pick])
                at = at + base[own]
                columns = [pa.array(b["rid"].to_numpy()[first:stop][own]), pa.array(pack[pick]), pa.array(kind[pick])]
                for length in levels:
                    step = window - length + 1
                    least = (back - n + 1) // step
                    many = back // step - least + 1
                    count = np.concatenate([[0], np.cumsum(many)])
                    k = np.arange(count[-1]) - np.repeat(count[:-1] - least, many)
                    head = np.repeat(at, many) - k * step
                    d = _digests(raw, start[head].tolist(), end[head + length - 1].tolist())
                    columns += [pa.array(least.astype(np.int32)), A.lists(d[:, 0], count), A.lists(d[:, 1], count)]
                yield pa.record_batch(columns, names=["rid", "pack", "kind", *(f"{c}_{x}" for x in levels for c in ("least", "d1", "d2"))])

    return run


def _kept(window: int):
    """The words that are left of each text, and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for column in (b["marks"], b["found"]):
                ends = np.asarray(column.offsets, np.int64)
                spans.append((ends, [x.to_numpy(zero_copy_only=False) for x in column.values.flatten()]))
            for first, stop, data, offsets in A.chunks(b["text"]):
                start, end, row = A.word_spans(data, offsets)
                base = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=stop - first))])
                own = lambda e: np.repeat(np.arange(stop - first), np.diff(e[first : stop + 1]))
                cover = np.zeros(len(start) + 1, np.int64)
                ends, (pack, kind) = spans[0]
                part = slice(ends[first], ends[stop])
                at, back, n = (x[kind[part] == 0] for x in _unpacked(pack[part]))
                head = at - back + base[own(ends)[kind[part] == 0]]
                np.add.at(cover, head, 1)
                np.add.at(cover, head + n - 1 + window, -1)
                ends, (pack, bits) = spans[1]
                part = slice(ends[first], ends[stop])
                i, before = np.nonzero(bits[part][:, None] >> np.arange(63) & 1)
                head = (_unpacked(pack[part])[0] + base[own(ends)])[i] - before
                np.add.at(cover, head, 1)
                np.add.at(cover, head + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                n = np.diff(np.concatenate([[0], np.cumsum(keep)])[base])
                raw, start, end = A.spaced(data, start, end)
                raw = raw[np.repeat(keep, end - start + 1)].tobytes()
                size = np.concatenate([[0], np.cumsum(np.where(keep, end - start + 1, 0))])[base].tolist()
                texts = [raw[x : max(x, y - 1)] for x, y in zip(size, size[1:])]
                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.record_batch(
                    [b["rid"].slice(first, stop - first), pa.array(np.diff(base) - n), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
                    names=["rid", "n_removed", "kept", "sha"],
                )

    return run


def _survivors(base: DataFrame, window: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """(rows, alive). rows: each row of base by number, rid, with n_words and sha. alive: the anchors that occur twice or more."""
    spark, id_type = base.sparkSession, base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, key long, n_words long, sha string, pack array<long>, gram array<long>, d1 array<long>, d2 array<long>"
    every = base.mapInArrow(_read(window, shortest), schema)
    every = saved(every.withColumn("rid", F.monotonically_increasing_id()), "anchors")  # numbered once, in the table
    rows = saved(every.select("rid", "doc_id", "key", "n_words", "sha"), "rows")
    flat = every.select("rid", F.explode(F.arrays_zip("pack", "gram", "d1", "d2")).alias("x")).select("rid", "x.*")
    repeated = saved(flat.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "repeated")
    released(spark)
    alive = saved(flat.join(repeated.hint("merge"), "gram", "left_semi"), "alive")
    dropped(every, repeated)
    released(spark)
    return rows, alive


def _marks(alive: DataFrame) -> DataFrame:
    """rid and the marks of each row that has any: pack, kind (0: all windows are repeated, 1: open, 2: stands for a class beside open ones)."""
    classes = alive.groupBy("gram", "d1", "d2").agg(F.count("*").alias("c"), F.first("rid").alias("rid"), F.first("pack").alias("pack"))
    classes = saved(classes, "classes")
    released(alive.sparkSession)
    open_ = classes.groupBy("gram").agg(F.count("*").alias("n"), F.min("c").alias("least")).filter("n > 1 AND least = 1").select("gram")
    open_ = classes.join(open_.hint("merge"), "gram", "left_semi").select("rid", "pack", F.when(F.col("c") == 1, 1).otherwise(2).alias("kind"))
    settled = classes.filter("c > 1").select("d1", "d2")
    settled = alive.join(settled.hint("merge"), ["d1", "d2"], "left_semi").select("rid", "pack", F.lit(0).alias("kind"))
    marks = saved(settled.unionByName(open_).groupBy("rid").agg(F.collect_list(F.struct("pack", "kind")).alias("marks")), "marks")
    dropped(alive, classes)
    released(alive.sparkSession)
    return marks


def _doubled(some: DataFrame, window: int, levels: list[int]) -> DataFrame:
    """rid, pack, bits: of each open anchor, its repeated windows, bit o for the one that starts o words before it."""
    schema = "rid long, pack long, kind int, " + ", ".join(f"least_{x} int, d1_{x} array<long>, d2_{x} array<long>" for x in levels)
    runs = saved(some.mapInArrow(_extended(window, levels), schema), "runs")
    alive, key = None, ["k", "d1", "d2"]
    for length in levels:
        step = window - length + 1
        now = runs
        if alive is not None:
            if alive.isEmpty():
                break
            now = now.join(alive.hint("merge"), ["rid", "pack"])
        now = now.select("*", F.posexplode(F.arrays_zip(F.col(f"d1_{length}").alias("d1"), F.col(f"d2_{length}").alias("d2"))).alias("nth", "run"))
        k = F.col("nth") + F.col(f"least_{length}")
        now = now.withColumn("covered", F.call_function("shiftleft", F.lit((1 << step) - 1).cast("long"), k * step))
        if alive is not None:
            now = now.filter(F.col("bits").bitwiseAND(F.col("covered")) != 0)
        now = now.select("rid", "pack", "kind", "covered", k.alias("k"), "run.d1", "run.d2")
        again = saved(now.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "again")
        # Only open anchors need an answer of the last level.
        now = now.filter("kind = 1") if length == window else now
        now = now.join(again.hint("merge"), key, "left_semi").groupBy("rid", "pack").agg(F.bit_or("covered").alias("bits"))
        old, alive = alive, saved(now, f"level{length}")
        dropped(again, *([] if old is None else [old]))
        released(some.sparkSession)
    dropped(runs)
    return alive


def substring_dedup(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the text left, null if nothing was removed), kept_sha256."""
    levels = lengths(window, shortest)
    if window < 2 or window - levels[0] + 1 > 62:
        raise ValueError("window: at least 2, and at most 61 words beyond the shortest level")
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows, alive = _survivors(base, window, levels[0])
    marks = _marks(alive)
    # Rows that repeat doc_id and text meet each other's marks, which are their own row's: one text of each stays.
    repeats = not rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    text = base.groupBy("doc_id", "key").agg(F.first("text").alias("text")) if repeats else base
    by = marks.join(rows.select("rid", F.col("doc_id").alias("_doc"), F.col("key").alias("_key")), "rid")
    some = text.join(by.hint("merge"), text["doc_id"].eqNullSafe(by["_doc"]) & (text["key"] == by["_key"])).select("rid", "text", "marks")
    some = saved(some, "some")
    dropped(marks)
    released(docs.sparkSession)
    found = _doubled(some, window, levels[1:])
    found = found.groupBy("rid").agg(F.collect_list(F.struct("pack", "bits")).alias("found"))
    none = F.array().cast("array<struct<pack:long,bits:long>>")
    cut = some.join(found.hint("merge"), "rid", "left").select("rid", "text", "marks", F.coalesce("found", none).alias("found"))
    cut = cut.mapInArrow(_kept(window), "rid long, n_removed long, kept string, sha string").withColumnRenamed("sha", "cut_sha").filter("n_removed > 0")
    return rows.join(cut, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept", F.coalesce("cut_sha", "sha").alias("kept_sha256")
    )
