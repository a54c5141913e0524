"""Cases in which an operator once did less than the whole job."""

import random
from collections import Counter

import pytest

from modelloom.llm import mixing, near_copies, simhash


def test_representatives_of_repeated_and_null_ids(rows):
    rng = random.Random(3)
    draw = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c, d, e = (draw() for _ in range(5))
    # Different texts under null, and under 7; a copy of 1's text under 7 and null; repeats of all of a row.
    pairs = [(None, a), (None, b), (None, b), (7, c), (7, d), (1, e), (7, e), (None, e), (7, d)]
    got = Counter((r.doc_id, r.text) for r in simhash.representatives(rows(pairs)).collect())
    assert got == Counter([(None, a), (None, b), (7, c), (7, d), (1, e)])


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(x, y):
    return x == y or (len(x & y) / len(x | y) >= 0.8 - 1e-9 if x and y else False)


@pytest.mark.parametrize("block, broadcast", [(4096, 10**6), (4, 0)])
def test_near_copies_against_brute_force(rows, block, broadcast):
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line = " ".join(draw(40))
    pairs = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "a b c d"), (5, "A\tb c  d"), (None, "a b c d e"), (9, "x " * 500), (10, "x " * 700)]
    copies = []
    for n, most in ((100, 3), (300, 8), (1000, 14)):
        for _ in range(12):
            base = draw(n)
            first = len(pairs) + 10
            pairs.append((first, " ".join(base)))
            for changes in range(1, most, 2):
                copy = list(base)
                for at in rng.sample(range(n), changes):
                    copy[at] = f"z{rng.randrange(10**6)}"
                copies.append((first, len(pairs) + 10))
                pairs.append((len(pairs) + 10, " ".join(copy)))
    pairs += [(1000 + i, line + " " + " ".join(draw(30 + i % 9))) for i in range(30)]
    base = draw(200)
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(6)):
            copy[at] = f"z{rng.randrange(10**6)}"
        pairs.append((2000 + i, " ".join(copy)))
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {}
    for r in near_copies.near_groups(rows(pairs), block=block, most_broadcast=broadcast).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    want = {}
    for i, (d, _) in enumerate(pairs):
        want.setdefault(find(i), []).append(d)
    order = lambda x: sorted(sorted(str(d) for d in ids) for ids in x.values())
    assert order(got) == order(want)
    # Of the pairs planted at 0.8 or more, all are in one group: recall is 1.
    at = {d: i for i, (d, _) in enumerate(pairs)}
    of = {d: r for r, ids in got.items() for d in ids}
    near = [(a, b) for a, b in copies if alike(sets[at[a]], sets[at[b]])]
    assert len(near) > 60 and all(of[a] == of[b] for a, b in near)
    assert near_copies.near_groups(rows([])).count() == 0


def test_small_source_beside_large_ones_gets_its_slots(spark):
    # At these places the sequence meets a share of one block with no slot at all.
    made = [(0, 18946 * 64, 18946.0 * 64), (1, 64, 64.0), (2, 1054 * 64, 1054.0 * 64)]
    got = mixing.schedule(spark.createDataFrame(made, "sid int, total long, target double")).collect()
    taken = Counter()
    for r in got:
        taken[r.sid] += r.use
    assert taken == {sid: int(target) for sid, _, target in made}
    assert len({r.slot for r in got}) == len(got) and len({(r.sid, r["pass"], r.k) for r in got}) == len(got)


def test_every_source_gets_exactly_its_slots(spark):
    rng = random.Random(9)
    # Shares of one block to thousands, in one schedule; sizes around whole blocks.
    made = [(i, n := rng.choice([1, 63, 64, 65, 50, 300, 5000, 90_000]), float(rng.randrange(1, 2 * n + 1))) for i in range(300)]
    got = mixing.schedule(spark.createDataFrame(made, "sid int, total long, target double")).collect()
    taken, order = Counter(), {}
    for r in sorted(got, key=lambda r: r.slot):
        taken[r.sid] += r.use
        assert order.get(r.sid, (-1, -1)) < (r["pass"], r.k)
        order[r.sid] = (r["pass"], r.k)
    assert taken == {sid: round(target) for sid, _, target in made}
    assert len({r.slot for r in got}) == len(got)


def test_mix_of_a_source_below_its_block(spark):
    sizes = {"a": 24_023, "b": 50, "c": 24_835}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(docs).orderBy("doc_id").collect()] == [48_046, 100, 25_216]


def test_mix_of_repeated_rows_keeps_its_sources(spark):
    text = "w " * 200
    docs = spark.createDataFrame([(1, text, "s0", 1), (1, text, None, 2), (2, text, "s1", 3), (2, text, "s1", 4)], "doc_id long, text string, source string, other int")
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len(r.text.split())
    # Weights 5, 2, 1 for s0, s1, null share 1200 words; no source gives over twice its own.
    assert taken == {"s0": 400, "s1": 533, None: 267}


def test_near_copies_link_by_fingerprints_first(spark, rows, monkeypatch):
    """Pairs of classes that SimHash leads through, and that the near-dedup stage takes them by pigeonring chains."""
    prints = [(1, 0b1011), (2, 0b1011), (3, 0b1000), (4, (1 << 63) - 1), (5, (1 << 40) - 1)]
    pairs = {(r.a, r.b) for r in near_copies.like_prints(spark.createDataFrame(prints, "sig long, fp long")).collect()}
    assert pairs == {(1, 2), (1, 3)}
    seen = []
    plain = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda classes, *a, **k: seen.append(classes.count()) or plain(classes, *a, **k))
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [(0, " ".join(base)), (1, " ".join([*base[:399], "other"])), (2, " ".join(reversed(base))), (3, None)]
    roots = {r.doc_id: r.root for r in near_copies.near_groups(rows(texts)).collect()}
    assert len(seen) == 1 and seen[0] >= 3 and roots[0] == roots[1] and len(set(roots.values())) == 3
