"""Quality by a linear-chain conditional random field over lines.

Each line has features of its own (shares of capitals, digits, symbols, bars, exclamation marks and
white space, length, length of words, words that repeat the one before or any other of the line,
whether the line came before in the text, its end) and the main ones of the lines next to it, each
cut into ranges. The lines of a document labelled good are good, of one labelled bad, bad; the field
weighs what its neighbours say. A document's score is the mean probability of good over its lines,
weighted by their length (an empty line counts as one byte).

The model is fitted on a bounded sample: `most` documents of each label. With no sample of either
label, all scores are 0.5. Null and empty text is one empty line. Rows are judged one by one, repeats
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modelloom.llm import textarrays as A
from modelloom.llm.crf import Crf, fit
from modelloom.llm.sampling import sample

MOST, BINS = 1500, 16
_SHARES = np.array([1e-9, 0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8])
_LENGTHS = np.array([1, 4, 10, 20, 40, 70, 110, 160, 240, 350, 500, 800, 1200, 2500, 6000])
_WORD_LENGTHS = np.array([0.5, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 9, 12, 20])
_KINDS = [np.array([f(chr(b)) and b < 128 for b in range(256)]) for f in (str.isupper, str.isdigit, lambda c: c in "%$&*#@^~=+<>{}[]\\/_", lambda c: c == "|", lambda c: c == "!", str.isspace)]
_OWN = 12
SIZE = BINS * _OWN * 3


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each line; every row has one at least."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    row = np.sort(owner, kind="stable")
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
    end[last] = offsets[1:]
    return start, end, row


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row, bytes) of each line."""
    start, end, row = lines(data, offsets)
    n = end - start
    size = np.maximum(n, 1)
    cut = []
    for kind in _KINDS:
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        cut.append(np.digitize((sums[end] - sums[start]) / size, _SHARES))
    w_start, w_end, _ = A.word_spans(data, offsets)
    w_line = np.searchsorted(start, w_start, "right") - 1
    sums = A.byte_sums(data)
    h = A.part_hashes(sums, w_start, w_end)
    words = np.bincount(w_line, minlength=len(start))
    some = np.maximum(words, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w_line[1:] == w_line[:-1])
    order = np.lexsort((h, w_line))
    other = np.zeros(len(h), bool)
    other[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (w_line[order[1:]] == w_line[order[:-1]])
    cut.append(np.digitize(n, _LENGTHS))
    cut.append(np.digitize(np.bincount(w_line, w_end - w_start, minlength=len(start)) / some, _WORD_LENGTHS))
    cut.append(np.digitize(np.bincount(w_line, again, minlength=len(start)) / some, _SHARES))
    cut.append(np.digitize(np.bincount(w_line, other, minlength=len(start)) / some, _SHARES))
    whole = A.part_hashes(sums, start, end)
    order = np.lexsort((np.arange(len(start)), whole, row))
    before = np.zeros(len(start), bool)
    before[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    cut.append(before & (n > 0))
    tail = np.where(n > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    cut.append(np.select([n == 0, np.isin(tail, list(b".!?")), np.isin(tail, list(b",;:"))], [0, 1, 2], 3))
    own = np.stack(cut, 1) + np.arange(_OWN) * BINS
    out = np.empty((len(start), 3 * _OWN), np.int32)
    out[:, :_OWN] = own
    same = row[1:] == row[:-1]
    none = (np.arange(_OWN) + 1) * BINS - 1
    out[:1, _OWN : 2 * _OWN] = out[-1:, 2 * _OWN :] = none
    out[1:, _OWN : 2 * _OWN] = np.where(same[:, None], own[:-1], none)
    out[:-1, 2 * _OWN :] = np.where(same[:, None], own[1:], none)
    out[:, _OWN : 2 * _OWN] += BINS * _OWN
    out[:, 2 * _OWN :] += 2 * BINS * _OWN
    return out, row, size


def _first(row: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)


def train(texts: list[tuple[int, str]]) -> Crf | None:
    """texts: (1 if good else 0, text)."""
    good = np.array([x for x, _ in texts], bool)
    if good.all() or not good.any():
        return None
    parts = [(f, r + first) for first, _, data, offsets in A.chunks(pa.array([t for _, t in texts])) for f, r, _ in [features(data, offsets)]]
    x, row = np.concatenate([f for f, _ in parts]), np.concatenate([r for _, r in parts])
    return fit(x, good[row], _first(row), SIZE, rounds=60)


def _score(model: Crf | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"], 2 << 20):
                n = stop - first
                x, row, size = features(data, offsets)
                p = np.full(len(row), 0.5) if model is None else model.marginals(model.scores(x), _first(row))
                score = np.bincount(row, p * size, minlength=n) / np.bincount(row, size, minlength=n)
                count = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
                yield pa.record_batch([b["doc_id"].slice(first, n), pa.array(np.clip(score, 0, 1)), A.lists(p.astype(np.float32), count)], names=["doc_id", "score", "lines"])

    return run


def learnt(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Crf | None:
    """labels: doc_id and quality, only rows that may be learnt from."""
    return train([(int(x > 0), t) for x, t in sample(docs, labels, "quality", most)])


def quality(docs: DataFrame, model: Crf | None) -> DataFrame:
    """One row for each row of docs: doc_id, score, lines (the probability of good for each)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {id_type}, score double, lines array<float>")
