"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores.

Words are runs of letters (ASCII letters, A-Z lower-cased, and all characters beyond ASCII). A word's
script is the range of its first character beyond ASCII, else Latin; only languages that were seen
in that script are candidates for it, or all where none was. A word's score for a language is the sum over
its hashed runs of 3 and 4 bytes (the space around it included) of the log of how much likelier the
run is there than in all languages, within +-`bound`. Viterbi picks a language for every word, with a
penalty for each switch, so a text of several languages falls into spans. The text's language is the
one with most letters in its spans; its score is its share of them.

The model is fitted on a bounded sample: `most` documents of each language. Texts that are null or
have no letter are `und` with score 0, as are all if there is nothing to learn from. Ties go to the
language first in code point order. Rows are judged one by one, repeats alike; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from modelloom.llm import textarrays as A
from modelloom.llm.sampling import sample

BITS, MOST, PENALTY, BOUND, UND = 16, 600, 6.0, 6.0, "und"
#: Ranges of lead bytes in UTF-8. Fixed values.
SCRIPTS = ((0x00, "latin"), (0xC2, "latin"), (0xCE, "greek"), (0xD0, "cyrillic"), (0xD5, "armenian"), (0xD7, "hebrew"), (0xD8, "arabic"), (0xE0, "indic"), (0xE1, "other"), (0xE3, "han"), (0xEA, "hangul"), (0xEE, "other"))
_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(SCRIPTS[np.searchsorted([a for a, _ in SCRIPTS], b, "right") - 1][1]) for b in range(256)], np.int8)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    #: For each run of 3 and of 4 bytes (by hash), each language's score.
    runs: np.ndarray
    #: Whether a language was seen in a script.
    scripts: np.ndarray


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the runs that end at each byte or just after it, two for each of n + 1 places; start, end, row, script of each word)."""
    start, end, row = A.word_spans(data, offsets, A.LETTER)
    text = np.full(len(data) + 5, 32, np.uint32)
    # A word's runs reach no further back than the space before it.
    text[4:-1] = np.where(A.LETTER[data], A.LOWER[data], 32)
    back = np.full(len(data) + 1, 9, np.int64)  # bytes of the word before a place, 9: enough
    for k in (0, 1, 2):
        at = start + k
        at = at[at <= end]
        back[at] = k
    last = text[4:].copy()
    last[end] = 32  # the place just after a word
    one, two, three = text[3:-1].copy(), text[2:-2].copy(), text[1:-3].copy()
    one[back < 1] = two[back < 2] = three[back < 3] = 32
    three[back < 2] = 0
    tri = last | one << 8 | two << 16
    quad = tri | three << 24
    down = np.uint32(32 - BITS)
    h3, h4 = (tri * np.uint32(2654435761)) >> down, ((quad ^ np.uint32(0x9E3779B9)) * np.uint32(2246822519)) >> down
    lead = np.concatenate([[0], np.cumsum(data >= 0xC2)])
    first = np.flatnonzero(data >= 0xC2)
    has = lead[end] > lead[start]
    script = np.full(len(start), _SCRIPT[0], np.int8)
    script[has] = _SCRIPT[data[first[lead[start[has]]]]]
    return np.stack([h3, h4], 1), start, end, row, script


def _inside(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The places of words: each byte, and the one just after."""
    mark = np.zeros(n + 2, np.int32)
    np.add.at(mark, start, 1)
    np.add.at(mark, end + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n + 1] > 0)


def train(texts: list[tuple[str, str]]) -> Model | None:
    """texts: (language, text)."""
    languages = sorted({x for x, _ in texts})
    if not languages:
        return None
    counts = np.zeros((2 << BITS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for k, language in enumerate(languages):
        for _, _, data, offsets in A.chunks(pa.array([t for x, t in texts if x == language])):
            data, offsets = A.apart(data, offsets)
            h, start, end, _, script = _runs(data, offsets)
            at = _inside(start, end, len(data))
            counts[:, k] += np.bincount(h[at, 0], minlength=2 << BITS) + np.bincount(h[at, 1] + (1 << BITS), minlength=2 << BITS)
            scripts[:, k] += np.bincount(script, end - start, minlength=len(_NAMES))
    out = []
    for part in (counts[: 1 << BITS], counts[1 << BITS :]):
        p = (part + 0.5) / (part.sum(0) + 0.5 * len(part))
        out.append(np.log(p) - np.log(p.mean(1, keepdims=True)))
    return Model(languages, np.concatenate(out).astype(np.float32), scripts >= 0.01 * np.maximum(scripts.sum(0), 1))


def viterbi(scores: np.ndarray, row: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each item, by row; scores: item by label. All rows go forward together, a step an item, longest first."""
    n, k = scores.shape
    if not n or k == 1:
        return np.zeros(n, np.int64)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # rows of at least t + 1 items
    best = scores[first].astype(np.float64)
    switch, top = np.zeros((n, k), bool), np.zeros(n, np.int16)
    out = np.empty(n, np.int64)
    last = first + size - 1
    for t in range(int(size[0])):
        m = int(live[t])
        if t:
            best, at = best[:m], first[:m] + t
            lead = best.argmax(1)
            most = best[np.arange(m), lead][:, None] - penalty
            jump = most > best
            switch[at], top[at] = jump, lead
            best = np.where(jump, most, best)
            best += scores[at] - best.max(1, keepdims=True)
        over = int(live[t + 1]) if t + 1 < len(live) else 0  # rows from here on end with this item
        out[last[over:m]] = best[over:m].argmax(1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = first[: live[t]] + t
        now = out[at]
        out[at - 1] = np.where(switch[at, now], top[at], now)
    return out


def language_spans(labels: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a span begins: another row, or another language than the word before."""
    return np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (labels[1:] != labels[:-1])]) if len(row) else np.zeros(0, np.int64)


def _tag(model: Model | None, penalty: float, bound: float):
    kinds = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in A.chunks(b["text"]):
                n = stop - first
                data, offsets = A.apart(data, offsets)
                names, share = np.full(n, UND, object), np.zeros(n)
                begin = finish = count = np.zeros(0, np.int64)
                spoken: list[str] = []
                per_row = np.zeros(n, np.int64)
                if model is not None:
                    runs, start, end, row, script = _runs(data, offsets)
                    k = len(model.languages)
                    word = np.empty((len(start), k), np.float32)
                    fits = model.scripts[script]
                    fits |= ~fits.any(1, keepdims=True)
                    for j in range(k):
                        table = model.runs[:, j]
                        sums = np.zeros(len(runs) + 1)
                        np.cumsum(table[runs[:, 0]] + table[(1 << BITS) + runs[:, 1]], out=sums[1:])
                        word[:, j] = sums[end + 1] - sums[start]
                    word = np.where(fits, np.clip(word, -bound, bound), -3 * bound).astype(np.float32)
                    label = viterbi(word, row, penalty)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    letters = np.bincount(row * k + label, chars[end] - chars[start], minlength=n * k).reshape(n, k)
                    best = letters.argmax(1)
                    has = letters.sum(1) > 0
                    plain = np.concatenate([[0], np.cumsum((data < 128) & A.LETTER[data])])
                    for r in np.flatnonzero(has & (plain[offsets[1:]] == plain[offsets[:-1]])):  # no ASCII letter: is there another?
                        has[r] = bool(_LETTER.search(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")))
                    at = np.arange(n)
                    names[has] = np.array(model.languages, object)[best[has]]
                    share[has] = (letters[at, best] / np.maximum(letters.sum(1), 1))[has]
                    cut = language_spans(label, row)
                    close = np.r_[cut[1:], len(row)] - 1 if len(cut) else cut
                    known = has[row[cut]]
                    cut, close = cut[known], close[known]
                    base = chars[offsets[row[cut]]]
                    begin, finish = chars[start[cut]] - base, chars[end[close]] - base
                    spoken = [model.languages[x] for x in label[cut]]
                    per_row = np.bincount(row[cut], minlength=n)
                count = np.concatenate([[0], np.cumsum(per_row)])
                spans = pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(finish.astype(np.int32)), pa.array(spoken, pa.string())], fields=list(kinds)))
                part = b.slice(first, n)
                yield pa.record_batch([part["doc_id"], pa.array(names.tolist(), pa.string()), pa.array(np.clip(share, 0, 1)), spans], names=["doc_id", "lang_pred", "score", "spans"])

    return run


def learnt(docs: DataFrame, rows: DataFrame, most: int = MOST) -> Model | None:
    """rows: those of docs that may be learnt from (doc_id and lang)."""
    return train(sample(docs, rows, "lang", most))


def identify(docs: DataFrame, model: Model | None, penalty: float = PENALTY, bound: float = BOUND) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, spans (start, end, lang)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_tag(model, penalty, bound), f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def identified(docs: DataFrame, model: Model | None, least: float = 0.0, penalty: float = PENALTY, bound: float = BOUND) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score over `least`."""
    tag = _tag(model, penalty, bound)

    def run(batches):
        for b in batches:
            one = pa.record_batch([b["text"], b["text"]], names=["doc_id", "text"])
            parts = list(tag(iter([one])))
            names = pa.chunked_array([p["lang_pred"] for p in parts]).combine_chunks() if parts else pa.array([], pa.string())
            score = np.concatenate([p["score"].to_numpy() for p in parts]) if parts else np.zeros(0)
            keep = (np.array(names.to_pylist(), object) != UND) & (score > least)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
