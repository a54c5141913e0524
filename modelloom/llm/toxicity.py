"""Toxicity by a linear-chain conditional random field over words.

Words are runs of letters and digits, A-Z lower-cased; features are hashes of the word, its first
3 to 5 bytes, its last 3, and the beginnings of its neighbours. Labels mark documents, so the tokens
to learn from are labelled first: in a toxic document, a word that itself, or by its beginning, is
far more frequent in toxic than in other documents of the sample. Forward-backward marginals of the
fitted field give each word's probability. A document's score is 1 - exp(-c), c the expected number
of toxic words (of those at `floor` or more, so that a long clean text does not add up), and its
spans are the words at 0.5 or more, as offsets in characters.

The model is fitted on a bounded sample: `most` toxic documents and four
times as many others. With no sample of either
label, all scores are 0. Null, empty and wordless texts score 0 and have no spans. Rows are judged
one by one, repeats alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm import textarrays as A
from modelloom.llm.crf import Crf, fit
from modelloom.llm.sampling import sample

BITS = 20
SIZE, MOST, OTHERS, FLOOR = 1 << BITS, 1000, 4, 0.05
#: A word to learn from: so many times more frequent in toxic documents, and so unlikely by chance (Chernoff's bound on the log).
RATIO, UNLIKELY = 10.0, 7.0
#: Which columns of features() name the word or its beginning: word, 5, 4.
_SEEDS = (0, 1, 2)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, start, end) of each word."""
    data = A.LOWER[data]
    start, end, row = A.word_spans(data, offsets, A.ITEM)
    sums = A.byte_sums(data)
    down = A.U64(64 - BITS)
    part = lambda s, e, k: (A.mixed(A.part_hashes(sums, s, e) + A.U64(k)) >> down).astype(np.int32)
    begin = part(start, np.minimum(start + 4, end), 3)
    near = A.mixed(begin.astype(A.U64))
    before, after = np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
    if len(start) > 1:
        same = row[1:] == row[:-1]
        before[1:] = np.where(same, (A.mixed(near[:-1] + A.U64(1)) >> down).astype(np.int32), 0)
        after[:-1] = np.where(same, (A.mixed(near[1:] + A.U64(2)) >> down).astype(np.int32), 1)
    out = [part(start, end, 1), part(start, np.minimum(start + 5, end), 2), begin, part(start, np.minimum(start + 3, end), 4), part(np.maximum(end - 3, start), end, 5), before, after]
    return np.stack(out, 1), row, start, end


def unlike(texts: list[tuple[int, str]], draws: int = 24, alike: float = 0.5) -> list[tuple[int, str]]:
    """Those that don't look like a copy of an earlier one: of the least hashes of their word pairs, in so many draws, at most
    this share is one earlier text's too.

    Words of a passage that is there in many copies would seem to mark what its copies are labelled."""
    out, seen = [], {}
    for first, end, data, offsets in A.chunks(pa.array([t for _, t in texts])):
        start, stop, row = A.word_spans(A.LOWER[data], offsets, A.ITEM)
        pairs = A.run_hashes(A.word_hashes(A.LOWER[data], start, stop), 2)
        own = row[: len(pairs)]
        inside = own == row[1 : 1 + len(pairs)]
        pairs, own = pairs[inside], own[inside]
        least = {}
        if len(own):
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            draw = np.stack([np.minimum.reduceat(A.mixed(pairs + A.U64(k)), at) for k in range(draws)], 1)
            least = {int(r): {(k, int(x)) for k, x in enumerate(xs)} for r, xs in zip(own[at], draw)}
        for r in range(end - first):
            mine = least.get(r, set())
            met = Counter(i for x in mine for i in seen.get(x, ()))
            if not met or max(met.values()) <= alike * draws:
                # What is left out is like one that stays, so only these need to be known.
                for x in mine:
                    seen.setdefault(x, []).append(len(out))
                out.append(texts[first + r])
    return out


def train(texts: list[tuple[int, str]], size: int = SIZE) -> Crf | None:
    """texts: (1 if toxic else 0, text). Words to learn from are picked with all of them, the field is fitted on as many clean as toxic ones."""
    texts = unlike(texts)
    toxic = np.array([x for x, _ in texts], bool)
    if toxic.all() or not toxic.any():
        return None
    bad, good = np.zeros((len(_SEEDS), size), np.int32), np.zeros((len(_SEEDS), size), np.int32)
    kept, clean = [], int(toxic.sum())
    few = toxic | (np.cumsum(~toxic) <= clean)
    for first, _, data, offsets in A.chunks(pa.array([t for _, t in texts])):
        x, row, _, _ = features(data, offsets)
        row = row + first
        for j in _SEEDS:
            once = np.unique(row.astype(np.int64) * size + x[:, j])
            docs, what = once // size, once % size
            bad[j] += np.bincount(what[toxic[docs]], minlength=size)
            good[j] += np.bincount(what[~toxic[docs]], minlength=size)
        kept.append((x[few[row]], row[few[row]]))
    x, row = np.concatenate([f for f, _ in kept]), np.concatenate([r for _, r in kept])
    del kept
    share = toxic.mean()
    seen = np.zeros(len(x), bool)
    for j in _SEEDS:
        n = np.maximum(bad[j] + good[j], 1)
        q = bad[j] / n
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
        rate = (bad[j] / toxic.sum()) / ((good[j] + 0.5) / (~toxic).sum())
        seen |= ((q > share) & (n * apart >= UNLIKELY) & (rate >= RATIO))[x[:, j]]
    labels = seen & toxic[row]
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    return fit(x, labels, first, size, rounds=30)


def _tag(model: Crf | None, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"], 2 << 20):
                n = stop - first
                score, count = np.zeros(n), np.zeros(n + 1, np.int64)
                begin = finish = np.zeros(0, np.int64)
                p = np.zeros(0)
                if model is not None:
                    x, row, start, end = features(data, offsets)
                    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                    p = model.marginals(model.scores(x), new)
                    score = -np.expm1(-np.bincount(row, np.where(p >= floor, p, 0), minlength=n))
                    hit = np.flatnonzero(p >= 0.5)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    base = chars[offsets[row[hit]]]
                    begin, finish, p = chars[start[hit]] - base, chars[end[hit]] - base, p[hit]
                    count = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=n))])
                spans = pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(finish.astype(np.int32)), pa.array(p)], ["start", "end", "p"]))
                yield pa.record_batch([b["doc_id"].slice(first, n), pa.array(score), spans], names=["doc_id", "score", "spans"])

    return run


def learnt(docs: DataFrame, labels: DataFrame, most: int = MOST, others: int = OTHERS) -> Crf | None:
    """labels: doc_id and toxic, only rows that may be learnt from. At most `most` toxic documents and `others` times as many that aren't."""
    bad, good = labels.filter("toxic > 0"), labels.filter("toxic <= 0")
    return train([(1, t) for _, t in sample(docs, bad, "toxic", most)] + [(0, t) for _, t in sample(docs, good, "toxic", others * most)])


def toxicity(docs: DataFrame, model: Crf | None, floor: float = FLOOR) -> DataFrame:
    """One row for each row of docs: doc_id, score, spans (start, end, p)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_tag(model, floor), f"doc_id {id_type}, score double, spans array<struct<start:int,end:int,p:double>>")


def clean(docs: DataFrame, model: Crf | None, most: float = 0.7) -> DataFrame:
    """The spans and scores of documents under the score `most`."""
    return toxicity(docs, model).filter(F.col("score") < most)
