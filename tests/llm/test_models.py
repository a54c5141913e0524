"""Classifiers: parts against brute force, and held-out accuracy on the test tables."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest

from modelloom.llm import crf, language_id, quality, queries, sampling, toxicity

SF = "/root/testdata/sf0.01"


def chain(model, scores):
    """Marginals of one sequence by all labellings."""
    total, one = 0.0, np.zeros(len(scores))
    for y in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(model.starts[y[0]] + sum(s * v for s, v in zip(scores, y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
        total, one = total + w, one + w * np.array(y)
    return one / total


def test_marginals():
    rng = np.random.default_rng(0)
    m = crf.Crf(np.zeros(1), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    s, first = rng.normal(size=900) * 2, rng.random(900) < 0.15
    first[0] = True
    p, moves, starts = m.marginals(s, first, pairs=True)
    assert moves.sum() == pytest.approx(900 - first.sum()) and starts.sum() == pytest.approx(first.sum())
    cuts = np.flatnonzero(np.r_[first, True])
    for a, b in zip(cuts, cuts[1:]):
        if b - a <= 10:
            assert np.allclose(p[a:b], chain(m, s[a:b]))
    assert len(m.marginals(np.zeros(0), np.zeros(0, bool))) == 0


def test_fit_learns_a_chain():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).cumsum() % 2 == 0
    x = np.stack([np.where(rng.random(4000) < 0.8, y, ~y).astype(int), np.full(4000, 2)], 1)
    first = np.zeros(4000, bool)
    first[::20] = True
    m = crf.fit(x, y, first, 3)
    assert ((m.marginals(m.scores(x), first) > 0.5) == y).mean() > 0.75


def test_fit_in_pieces_is_the_same_and_takes_less(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    n, size = 200_000, 1000
    x, y, first = rng.integers(0, size, (n, 7)).astype(np.int32), rng.random(n) < 0.1, rng.random(n) < 0.01
    first[0] = True
    first[100:30_000] = False  # a sequence longer than a piece
    most, models = [], []
    for piece in (n, 10_000):
        monkeypatch.setattr(crf, "PIECE", piece, raising=False)
        tracemalloc.start()
        models.append(crf.fit(x, y, first, size, rounds=3))
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-5) and np.allclose(models[0].moves, models[1].moves)
    assert most[1] < most[0] / 3
    pieces = crf._pieces(first, 10_000)
    assert [a for a, _ in pieces] == [0, *(b for _, b in pieces[:-1])] and pieces[-1][1] == n and all(first[a] for a, _ in pieces)


def test_viterbi():
    rng = np.random.default_rng(2)
    s, row = rng.normal(size=(60, 3)) * 2, np.sort(rng.integers(0, 12, 60))
    got = language_id.viterbi(s, row, 1.5)
    for r in set(row.tolist()):
        at = np.flatnonzero(row == r)
        if len(at) < 9:
            best = max(itertools.product(range(3), repeat=len(at)), key=lambda y: sum(s[i, k] for i, k in zip(at, y)) - 1.5 * sum(a != b for a, b in zip(y, y[1:])))
            assert tuple(got[at]) == best


ODD = [None, "", "   ", "123 !?", "— …", "|||", "a", "語", "\n\n", "x " * 30_000]


@pytest.mark.parametrize("trained", [True, False])
def test_odd_texts(spark, rows, trained):
    good, bad = "the and of with that this is. " * 20, "%%% | !!! THE ### " * 20
    toxic = [(1, f"some u{i}a words u{i}b vile{i % 3} here u{i}c and vile{i % 2} again u{i}d") for i in range(40)] + [(0, f"plain u{i}e words u{i}f here and some u{i}g again") for i in range(80, 200)]
    models = (
        toxicity.train(toxic) if trained else toxicity.train([]), quality.train([(1, good)] * 5 + [(0, bad)] * 5) if trained else quality.train([(1, good)]),
        language_id.train([("en", good), ("de", "der die und das nicht einer " * 20), ("ru", "это и не на что " * 20)]) if trained else language_id.train([]),
    )
    df = rows([(i, t) for i, t in enumerate(ODD)] + [(None, "der die das"), (3, "это не на что"), (3, "это не на что")])
    t = toxicity.toxicity(df, models[0]).collect()
    q = quality.quality(df, models[1]).collect()
    lang = language_id.identify(df, models[2]).collect()
    assert len(t) == len(q) == len(lang) == len(ODD) + 3
    assert all(0 <= r.score <= 1 for r in (*t, *q, *lang))
    by = {r.doc_id: r for r in lang}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 4, 5, 8))
    assert by[7].lang_pred != "und" if trained else by[7].lang_pred == "und"
    if trained:
        assert by[None].lang_pred == "de" and by[3].lang_pred in ("ru", "und")
        assert language_id.identified(df, models[2]).columns == df.columns
        assert language_id.identified(df, models[2]).count() == len(ODD) + 3 - 7
        assert {r.doc_id: r.score for r in t}[0] == 0.0
        spans = toxicity.toxicity(rows([(1, "é vile1 x VILE0")]), models[0]).first().spans
        assert [(s.start, s.end) for s in spans] == [(2, 7), (10, 15)]
    for f in (lambda d: toxicity.toxicity(d, models[0]), lambda d: quality.quality(d, models[1]), lambda d: language_id.identify(d, models[2])):
        assert f(rows([])).count() == 0


def test_mixed_language_spans():
    model = language_id.train([("en", "the and of with that this is they " * 50), ("de", "der die und das nicht einer auf wird " * 50)])
    b = pa.record_batch([pa.array([1]), pa.array(["they this the and of with that der und das nicht einer auf wird die nicht"])], names=["doc_id", "text"])
    out = next(language_id._tag(model, 6.0, 6.0)(iter([b]))).to_pylist()[0]
    assert [s["lang"] for s in out["spans"]] == ["en", "de"] and out["lang_pred"] == "de" and 0.5 < out["score"] < 0.7


def test_lines():
    data = np.frombuffer(b"a\nb\n\nc", np.uint8)
    start, end, row = quality.lines(data, np.array([0, 3, 3, 6]))
    assert list(zip(start.tolist(), end.tolist(), row.tolist())) == [(0, 1, 0), (2, 3, 0), (3, 3, 1), (3, 3, 2), (4, 4, 2), (5, 6, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,label,guess,least", [("op3_toxicity", "toxic", "predicted", 0.94), ("op4_quality", "quality", "predicted", 0.97), ("op5_language_id", "lang", "lang_pred", 0.97)])
def test_held_out_accuracy(spark, name, label, guess, least):
    table = "documents" if label == "lang" else "labels"
    want = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", label).collect()}
    got = [r for r in queries.queries()[name](spark, SF).collect() if r.held_out and r.doc_id in want]
    assert len(got) > 50 and np.mean([want[r.doc_id] == r[guess] for r in got]) >= least


def test_fold(spark):
    import zlib

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i,) for i in (0, 5, 123456, -7)], "doc_id long")
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 3 for r in df.select("doc_id", sampling.fold(F.col("doc_id"), 3)).collect())


def _batch(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


def test_toxicity_by_hand():
    import re

    toxic = [(1, f"some u{i}a words u{i}b vile{i % 3} here u{i}c and vile{i % 2} again u{i}d") for i in range(40)] + [(0, f"plain u{i}e words u{i}f here and some u{i}g again") for i in range(80, 200)]
    model = toxicity.train(toxic)
    texts = ["some VILE0 here", "é vile1, x", "", "nothing of note", "vile2vile2 vile", "words-and  vile0 vile1", "?!", "a"]
    cut = [[(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9\x80-\U0010ffff]+", t)] for t in texts]
    words = [t.lower()[a:b] if t.isascii() else t[a:b] for t, spans in zip(texts, cut) for a, b in spans]
    data, offsets = _batch(texts)
    x, row, start, end = toxicity.features(data, offsets)
    # Features say which words are alike: by all of the word, its first 5, 4 and 3 bytes, and its last 3.
    ways = [lambda w: w, lambda w: w[:5], lambda w: w[:4], lambda w: w[:3], lambda w: w[-3:]]
    raw = [w.encode() for w in words]
    assert len(x) == len(words)
    for j, way in enumerate(ways):
        assert all((x[a, j] == x[b, j]) == (way(raw[a]) == way(raw[b])) for a in range(len(raw)) for b in range(len(raw)))
    # Neighbours count within a text only.
    alone = [toxicity.features(*_batch([t]))[0] for t in texts]
    assert (np.concatenate([a for a in alone if len(a)]) == x).all()
    out = list(toxicity._tag(model, toxicity.FLOOR)(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])))[0].to_pylist()
    for got, mine, spans in zip(out, alone, cut):
        p = chain(model, model.scores(mine)) if len(mine) else np.zeros(0)
        assert got["score"] == pytest.approx(1 - np.exp(-p[p >= toxicity.FLOOR].sum()), abs=1e-6)
        assert [(s["start"], s["end"]) for s in got["spans"]] == [s for s, q in zip(spans, p) if q >= 0.5]


def test_only_copies_leave_the_sample():
    import random

    rng = random.Random(2)
    draw = lambda: [f"w{rng.randrange(3000)}" for _ in range(120)]
    common = ["the", "same", "opening", "words"]
    texts = [(0, " ".join(common + draw())) for _ in range(200)]
    base = draw()
    near = [(1, " ".join(base)), (1, " ".join([*base[:60], "other", *base[61:]])), (1, " ".join(base))]
    assert toxicity.unlike([*texts, *near]) == [*texts, near[0]]


def test_quality_by_hand():
    texts = ["Good line of words.\nanother one, it is\n\n### ||| !!!\nGood line of words.", "", "one\n", "a a a b a\n100% $5 {x}\t/ \\\n", "É café, ok:"]
    data, offsets = _batch(texts)
    x, row, size = quality.features(data, offsets)
    kinds = [str.isupper, str.isdigit, lambda c: c in "%$&*#@^~=+<>{}[]\\/_", lambda c: c == "|", lambda c: c == "!", str.isspace]
    at = 0
    for r, text in enumerate(texts):
        seen, rows = [], []
        for line in text.encode().split(b"\n"):
            n, words = len(line), line.split()
            share = lambda k, of: k / max(of, 1)
            own = [np.digitize(share(sum(f(chr(b)) and b < 128 for b in line), n), quality._SHARES) for f in kinds]
            own += [np.digitize(n, quality._LENGTHS), np.digitize(share(sum(map(len, words)), len(words)), quality._WORD_LENGTHS)]
            own.append(np.digitize(share(sum(a == b for a, b in zip(words, words[1:])), len(words)), quality._SHARES))
            own.append(np.digitize(share(len(words) - len(set(words)), len(words)), quality._SHARES))
            own.append(int(n > 0 and line in seen))
            own.append(0 if not n else 1 if line[-1:] in b".!?" else 2 if line[-1:] in b",;:" else 3)
            seen.append(line)
            rows.append([int(v) + quality.BINS * i for i, v in enumerate(own)])
        own = len(rows[0])
        none = [(i + 1) * quality.BINS - 1 for i in range(own)]
        for i, mine in enumerate(rows):
            before, after = rows[i - 1] if i else none, rows[i + 1] if i + 1 < len(rows) else none
            assert row[at] == r and x[at].tolist() == [*mine, *(v + quality.BINS * own for v in before), *(v + 2 * quality.BINS * own for v in after)]
            at += 1
    assert at == len(x)
    model = quality.train([(1, "the and of with that this is. " * 20)] * 5 + [(0, "%%% | !!! THE ### " * 20)] * 5)
    out = list(quality._score(model)(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])))[0].to_pylist()
    for r, got in enumerate(out):
        p = chain(model, model.scores(x[row == r]))
        assert got["score"] == pytest.approx((p * size[row == r]).sum() / size[row == r].sum(), abs=1e-6) and got["lines"] == pytest.approx(p.tolist(), abs=1e-5)


def test_language_by_hand():
    model = language_id.train([("en", "the and of with that this is they " * 50), ("de", "der die und das nicht einer auf wird " * 50), ("ru", "это и не на что они " * 50)])
    texts = ["this der die", "und", "the", "это that", "x", "wird.the", "", "not nicht"]
    k, size = len(model.languages), 1 << language_id.BITS

    def score(word: bytes) -> np.ndarray:
        """The sum over its places, the one just after it included, of its runs of 3 and 4 bytes that end there."""
        out = np.zeros(k)
        w = word.decode().encode()
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        for i in range(len(w) + 1):
            far = min(i, 9) if i > 2 else i
            get = lambda d: w[i - d] if far >= d else 32  # noqa: E731, B023
            last = w[i] if i < len(w) else 32
            tri = last | get(1) << 8 | get(2) << 16
            quad = tri | (0 if far < 2 else get(3)) << 24
            out += model.runs[(tri * 2654435761 % (1 << 32)) >> (32 - language_id.BITS)]
            out += model.runs[size + (((quad ^ 0x9E3779B9) * 2246822519 % (1 << 32)) >> (32 - language_id.BITS))]
        return out

    def script(word: bytes) -> int:
        lead = [b for b in word if b >= 0xC2]
        return language_id._SCRIPT[lead[0] if lead else 0]

    import re

    out = list(language_id._tag(model, 6.0, 6.0)(iter([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])])))[0].to_pylist()
    for text, got in zip(texts, out):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())
        if not words:
            assert got["lang_pred"] == "und"
            continue
        fits = [model.scripts[script(w)] if model.scripts[script(w)].any() else np.ones(k, bool) for w in words]
        s = [np.where(f, np.clip(score(w), -6, 6), -18) for f, w in zip(fits, words)]
        best = max(itertools.product(range(k), repeat=len(words)), key=lambda y: sum(v[a] for v, a in zip(s, y)) - 6.0 * sum(a != b for a, b in zip(y, y[1:])))
        letters = np.bincount(best, [len(w.decode()) for w in words], minlength=k)
        assert got["lang_pred"] == model.languages[int(letters.argmax())] and got["score"] == pytest.approx(letters.max() / letters.sum())
