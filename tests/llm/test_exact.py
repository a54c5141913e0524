"""Operators whose results are exact, against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from modelloom.llm import components, decontaminate, exact_dedup, mixing, simhash, substring_dedup, token_output, url_filter, wavelet

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- exact dedup


def dedup_brute(pairs):
    t = [(i, (x or "").translate(LOWER)) for i, x in pairs]
    groups = defaultdict(list)
    for i, x in t:
        groups[x].append(i)
    out = Counter()
    seen = set()
    for i, x in t:
        ids = [j for j in groups[x] if j is not None]
        keep = max(ids) if ids else None
        first = (i, x) not in seen
        seen.add((i, x))
        out[str((i, keep, len(groups[x]), i == keep and first, hashlib.sha256(x.encode()).hexdigest()))] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 4}, {"block_bytes": 4, "block_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(3))}])
def test_exact_dedup(rows, options):
    long = "ab" * 40_000 + "Ä"  # some blocks by default, thousands at 4 bytes
    pairs = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "Ä"), (6, "ä"), (7, long), (8, long), (9, long + "x"), (9, long + "x"), (None, "abc"), (None, "q"), (10, "abcdabcd"), (11, "abcd")]
    got = Counter(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.exact_dedup(rows(pairs), **options).collect())
    assert got == dedup_brute(pairs)


def test_exact_dedup_of_nothing(rows):
    assert exact_dedup.exact_dedup(rows([])).count() == 0


# ---- decontamination


def words(t):
    out, now = [], ""
    for c in (t or "").translate(LOWER):
        if c.isascii() and not (c.isdigit() or c.islower()):
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def contamination_brute(docs, items, size):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - min(size, len(w))) + 1 if w else 0):
            windows[tuple(w[k : k + min(size, len(w))])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, size + 1):
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out.append(str((d, len(w), len(hit), sorted(ids))))
    return sorted(out)


@pytest.mark.parametrize("most", [10**8, 0])
@pytest.mark.parametrize("size", [10, 3])
def test_decontamination(spark, rows, size, most):
    rng = random.Random(2)
    draw = lambda n: " ".join(rng.choice("a b c d É 1".split()) for _ in range(n))
    base = draw(14)
    docs = [(1, base), (2, f"x, {base.upper().replace('É', 'é')}! y"), (3, None), (4, ""), (5, "??"), (6, draw(400)), (7, base + " " + base), (7, base + " " + base), (8, "Zeta q1"), (9, "zeta  Q1 zeta"), (10, draw(30)), (11, "long " * 40_000 + base)]
    items = [(1, base), (2, draw(11)), (3, None), (4, "!"), (5, "zeta q1"), (15, base), (15, base), (6, draw(3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(rows(docs), bench, size, most)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in got.collect()) == contamination_brute(docs, items, size)
    kept = {r.doc_id for r in decontaminate.decontaminated(rows(docs), bench, size, most).collect()}
    assert kept == {d for d, _ in docs} - {r.doc_id for r in got.filter("n_hit > 0").collect()}


def test_decontamination_of_and_with_nothing(spark, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(rows([(1, "a b")]), empty).collect()] == [(2, 0)]
    assert decontaminate.contamination(rows([]), empty).count() == 0


# ---- substring dedup


def substring_brute(pairs, window):
    w = [(t or "").encode().split() for _, t in pairs]  # of bytes: at ASCII white space only
    count = Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    out = []
    for (d, _), x in zip(pairs, w):
        cover = {j for i in range(len(x) - window + 1) if count[tuple(x[i : i + window])] > 1 for j in range(i, i + window)}
        out.append(str((d, len(x), len(cover), hashlib.sha256(b" ".join(v for j, v in enumerate(x) if j not in cover)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("window, shortest", [(35, 9), (35, 3), (3, 9), (2, 1), (61, 9)])
def test_substring_dedup(rows, window, shortest):
    rng = random.Random(3)
    p = [rng.choice("abcdefgh") for _ in range(300)]
    pairs = [(1, "a " * 36), (2, "b " * 35), (3, " ".join(p)), (4, " ".join([*p[20:90], "zz", *p[100:160]])), (5, None), (6, ""), (7, " ".join(p)), (7, " ".join(p)), (None, "x y\n" * 30), (8, "q " * 200 + " ".join(p[:50])), (9, "one two")]
    # A common line in many texts, cut off at both ends, and one very long text that holds the passage twice.
    line = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    pairs += [(20 + i, " ".join([f"u{i}{j}" for j in range(9)] + line[rng.randrange(20) : 40 + rng.randrange(40)] + [f"v{i}"] * 5)) for i in range(30)]
    pairs += [(60, " ".join([*line, *(f"n{i}" for i in range(60_000)), "\t", *line])), (61, f"{chr(233)} \u00a0x " * 20)]
    got = substring_dedup.substring_dedup(rows(pairs), window, shortest).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == substring_brute(pairs, window)


def test_substring_dedup_compares_words(rows):
    # Words of equal polynomial hash modulo 2^64, whatever the base: a Thue-Morse string and its complement.
    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    b = "".join("ba"[i.bit_count() & 1] for i in range(2048))
    same = [f"w{i}" for i in range(34)]
    pairs = [(1, " ".join([*same, a])), (2, " ".join([*same, b]))]
    assert [r.n_removed for r in substring_dedup.substring_dedup(rows(pairs)).collect()] == [0, 0]
    # Nor does a clash of the hashes that choose anchors matter.
    pairs = [(1, " ".join([a, *same])), (2, " ".join([b, *same])), (3, " ".join([a, *same]))]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(rows(pairs)).collect()) == [(1, 35), (2, 0), (3, 35)]


def test_substring_dedup_of_nothing(rows):
    assert substring_dedup.substring_dedup(rows([])).count() == 0


# ---- URL filters


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x/", "block"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block"), (None, "/", "block")]
    urls = [
        "http://example.net/en/1", "https://X.Example.NET/en/", "http://a.example.net/en/x/y", "http://b.a.example.net/en/x", "http://net", "http://net/", "http://notnet/", "http://example.net?x=/en/", "http://example.com/de/#a",
        "http://www.example.com/De/", "http://org/fr/?q", "http://a.org#/fr/", "nothing", None, "", "://", "http:///de/", "http://netx.net/a", "http://internet/a", "http://a.net/" + "x" * 200_000, "http://" + "a." * 300 + "example.net/en/",
    ]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate([*urls, *urls[:2]])], "page_id long, url string, verdict string")
    pages = pages.unionByName(pages.limit(1))

    def judge(u):
        rest = (u or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(LOWER), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in sorted(rules[:5]) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for options in ({}, {"buckets": 16, "most_bytes": 0}, {"most_starts": 1}):
        got = url_filter.judge_urls(pages, table, **options).collect()
        assert len(got) == len(urls) + 3
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge([*urls, *urls[:2]][r.page_id])
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


# ---- SimHash


def fingerprint(t, size=4):
    w = (t or "").translate(LOWER).encode().split()
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(rows):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    pairs = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, " a\tB\n c  d e "), (None, "a b c d e")]
    for i in range(10, 60):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(300)] = "zz"
        pairs.append((i, " ".join(copy)))
    pairs += [(70, " ".join(base)), (70, " ".join(base)), (80, "x " * 20_000)]
    fp = [fingerprint(t) for _, t in pairs]
    for block in (4096, 4):
        got = simhash.near_groups(rows(pairs), block=block).collect()
        assert sorted(str((r.doc_id, r.fp & (1 << 64) - 1)) for r in got) == sorted(str((d, f)) for (d, _), f in zip(pairs, fp))
        root = list(range(len(pairs)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(pairs)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    root[max(find(i), find(j))] = min(find(i), find(j))
        least = {}
        for i, (d, _) in enumerate(pairs):
            if d is not None:
                least[find(i)] = min(d, least.get(find(i), d))
        assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(str((d, least.get(find(i)))) for i, (d, _) in enumerate(pairs))
    kept = sorted(r.doc_id for r in simhash.representatives(rows(pairs)).collect())
    assert kept == sorted(set(least.values()))
    assert simhash.near_groups(rows([])).count() == 0


def test_every_near_pair_shares_a_key():
    rng = random.Random(6)
    for distance, segments, chain in ((4, 9, 4), (4, 16, 7), (3, 8, 3)):
        masks = simhash.chain_masks(distance, segments, chain)
        for _ in range(400):
            a = rng.getrandbits(64)
            x = 0
            for b in rng.sample(range(64), rng.randint(0, distance)):
                x |= 1 << b
            assert any(x & m == 0 for m in masks)
            assert simhash._near(np.array([x], np.uint64), distance, segments)[0]
            far = sum(1 << b for b in rng.sample(range(64), distance + 1))
            assert not simhash._near(np.array([far], np.uint64), distance, segments)[0]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(-99, 99), rng.randrange(-99, 99)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- mixing


def water(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, goal, capped = {s: weights[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        rest = goal - sum(2 * sizes[s] for s in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and t[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing(rows):
    rng = random.Random(7)
    pairs = [(i, " ".join("w" for _ in range(rng.randrange(0, 300)))) for i in range(120)] + [(200, None), (201, ""), (5, "r " * 70), (5, "r " * 70), (300, "long " * 6000), (None, "n " * 10)]
    df = rows(pairs)
    source = Counter()
    size = {}
    for r in df.select("doc_id", "text", "source").collect():
        source[r.source] += len((r.text or "").split())
    t = water(dict(source))
    got = mixing.mix(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(got) == len(pairs) + 0
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            assert r.target == pytest.approx(t[r.source]) and r.source_size == source[r.source]
        taken[r.source if r.doc_id is not None else None] += r.taken
    for s in source:
        assert abs(taken[s] - t[s]) <= 1
    again = sorted(str(tuple(r)) for r in mixing.mix(df.repartition(3)).collect())
    assert again == sorted(str(tuple(r)) for r in mixing.mix(df).collect())
    clash = df.withColumns({c: F.lit(1) for c in ("_doc", "_o", "_o2", "_first", "_n", "_size", "_pass", "_sid", "_row", "first", "nth", "doc", "a.b")})
    docs = mixing.mixed_documents(clash)
    assert docs.columns == clash.columns
    assert sum(len(r.text.split()) for r in docs.collect()) == sum(r.taken for r in got)
    assert mixing.mix(rows([])).count() == 0 and mixing.mix(rows([(1, None)])).first().taken == 0


# ---- token output


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 40, "most_kept": 8}])
def test_token_output(rows, options):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_output.vocabulary())
    pairs = [(3, "Hello  world\n\nit's 5.5!"), (1, None), (2, ""), (7, "a b. c\nDé fé,\tx 語"), (7, "a b. c\nDé fé,\tx 語"), (5, " lead and trail "), (9, "word " * 3000 + "end"), (4, "x y  z")]
    shards = token_output.write_shards(rows(pairs), partitions=3, **options)
    got = sorted(tuple(r) for r in token_output.read_shards(shards).collect())
    want, at = [], 0
    for i, x in sorted(pairs, key=lambda p: (p[0], p[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert token_output.token_output(rows([])).count() == 0


def test_export(rows, tmp_path):
    shards = token_output.write_shards(rows([(1, "a b"), (2, "c")]), partitions=1)
    path = token_output.export(shards, str(tmp_path))[0]
    w = wavelet.WaveletMatrix(open(path, "rb").read())
    assert w.doc_ids() == [1, 2] and w.access(w.tokens - 1) == 2 and w.locate(2) == [e - 1 for e in w.ends().tolist()]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 4), (1, 1), (700, 5), (3000, 17)):
        a = rng.integers(0, 1 << bits, n).astype(np.uint32)
        w = wavelet.WaveletMatrix(wavelet.encode(a, [1], [n], bits))
        assert (w.all() == a).all()
        for i in range(0, n, 97):
            assert w.access(i) == a[i] and w.rank(int(a[i]), i) == (a[:i] == a[i]).sum()
            assert w.locate(int(a[i])) == np.flatnonzero(a == a[i]).tolist()
        with pytest.raises(IndexError):
            w.access(n)
