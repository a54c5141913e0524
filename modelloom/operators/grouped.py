"""Sequential algorithms, each over one bounded group: clustering, a linear classifier, isomorphism, small programs."""

from __future__ import annotations

import math
import time
import random
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def average_linkage(d: np.ndarray, threshold: float = 0.7, k: int | None = None) -> list[int]:
    """Cluster of each item, numbered by least member. The first of equally near pairs merges, while it is no farther than the threshold, or until k are left."""
    n = len(d)
    members, total = [[i] for i in range(n)], np.array(d, float)
    np.fill_diagonal(total, np.inf)
    alive = list(range(n))
    while len(alive) > max(1, k or 1):
        size = np.array([len(members[i]) for i in alive], float)
        mean = total[np.ix_(alive, alive)] / np.outer(size, size)
        mean[np.tril_indices(len(alive))] = np.inf
        at = int(mean.argmin())
        a, b = alive[at // len(alive)], alive[at % len(alive)]
        if k is None and mean.flat[at] > threshold + 1e-12:
            break
        members[a] += members[b]
        total[a] += total[b]
        total[:, a] = total[a]
        total[a, a] = np.inf
        alive.remove(b)
    out = [0] * n
    for c, i in enumerate(sorted(alive, key=lambda i: min(members[i]))):
        for x in members[i]:
            out[x] = c
    return out


#: Distances that are held at once, in average_linkage_of.
MOST_HELD = 1 << 21


def average_linkage_of(u: np.ndarray, threshold: float = 0.7) -> list[int]:
    """average_linkage() by cosine distance, from the vectors of length 1 rather than from all distances.

    The mean distance of two clusters is 1 less the product of their mean vectors, so a cluster is one vector, and memory grows
    with the vectors. Each cluster knows its nearest later one. A merge brings none nearer than the nearer of the two was, so what a
    cluster knows stays a lower bound, and is only renewed when it is the least of all. Distances count to 12 digits: so equally near
    pairs are those that would be without rounding errors."""
    n = len(u)
    mean, size, first = np.array(u, float), np.ones(n), np.arange(n)
    owner = np.arange(n)  # of each item: the first item of the cluster that it was last merged into
    near, far, stale, dead = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, bool), np.zeros(n, bool)
    step = max(1, MOST_HELD // max(1, n))
    for i in range(0, n - 1, step):
        d = np.round(np.clip(1 - mean[i : i + step] @ mean[i:].T, 0, 2), 12)
        d[np.tril_indices(len(d), 0, d.shape[1])] = np.inf
        near[i : i + step] = d.argmin(1) + i
        far[i : i + step] = d.min(1)
    left = n
    while left > 1:
        a = int(far.argmin())
        if far[a] > threshold + 1e-12:
            break
        if stale[a]:
            d = np.round(np.clip(1 - mean[a:] @ mean[a], 0, 2), 12)
            d[dead[a:]] = d[0] = np.inf
            at = int(d.argmin())
            near[a], far[a], stale[a] = a + at, d[at], False
            continue
        b = int(near[a])
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        owner[first[b]] = first[a]
        dead[b], far[b] = True, np.inf
        stale |= (near == a) | (near == b)
        stale[a] = True
        left -= 1
        if 2 * left < len(mean) and left > 64:
            keep = np.flatnonzero(~dead)
            moved = np.cumsum(~dead) - 1
            # A nearest that is gone was merged: that cluster is stale, so where it points doesn't count.
            near = moved[near[keep]]
            mean, size, first, far, stale, dead = mean[keep], size[keep], first[keep], far[keep], stale[keep], dead[keep]
    for i in range(n):  # owners come before what they own
        owner[i] = owner[owner[i]]
    return np.unique(owner, return_inverse=True)[1].tolist()


def cluster_groups(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """grp, id, cluster. df: grp, id, vec (array). Zero vectors are -1, not clustered."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        v = np.array(pdf["vec"].tolist(), float)
        size = np.linalg.norm(v, axis=1)
        has = np.flatnonzero(size > 0)
        out = np.full(len(pdf), -1)
        if len(has):
            u = v[has] / size[has, None]
            out[has] = average_linkage_of(u, threshold)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "cluster": out})

    kinds = dict(df.dtypes)
    return df.select("grp", "id", "vec").groupBy("grp").applyInPandas(one, f"grp {kinds['grp']}, id {kinds['id']}, cluster int")


def rand_index(a: list, b: list) -> float:
    """Adjusted for chance; 1 where there is nothing to compare."""
    if len(a) != len(b):
        raise ValueError("labellings of different lengths")
    cells, rows, columns = defaultdict(int), defaultdict(int), defaultdict(int)
    for x, y in zip(a, b):
        cells[x, y] += 1
        rows[x] += 1
        columns[y] += 1
    c2 = lambda d: sum(math.comb(v, 2) for v in d.values())
    total = math.comb(len(a), 2)
    if not total:
        return 1.0
    expected, most = c2(rows) * c2(columns) / total, (c2(rows) + c2(columns)) / 2
    return 1.0 if most == expected else (c2(cells) - expected) / (most - expected)


def bootstrap(d: np.ndarray, labels: list[int], draws: int = 25, seed: int = 0, threshold: float = 0.7) -> list[float]:
    """Agreement of the labels with those of each draw (with replacement, each item once) clustered anew."""
    n, rng = len(labels), random.Random(seed)
    if n < 3:
        return [1.0] * draws
    out = []
    for _ in range(draws):
        pick = sorted({rng.randrange(n) for _ in range(n)})
        out.append(rand_index([labels[i] for i in pick], average_linkage(d[np.ix_(pick, pick)], threshold)))
    return out


class LinearSvm:
    """One against the rest, hinge loss, stochastic steps in an order drawn from one generator."""

    def __init__(self, epochs: int = 50, rate: float = 0.1, penalty: float = 0.01, seed: int = 0):
        self.epochs, self.rate, self.penalty, self.seed = epochs, rate, penalty, seed
        self.weights: dict[str, dict[str, float]] = {}
        self.bias: dict[str, float] = {}

    def fit(self, rows: list[dict[str, float]], labels: list[str]) -> LinearSvm:
        rng = random.Random(self.seed)
        for c in sorted(set(labels)):
            w, b, order = defaultdict(float), 0.0, list(range(len(rows)))
            for _ in range(self.epochs):
                rng.shuffle(order)
                for i in order:
                    y = 1.0 if labels[i] == c else -1.0
                    margin = y * (sum(w[f] * x for f, x in rows[i].items()) + b)
                    for f in w:
                        w[f] *= 1 - self.rate * self.penalty
                    if margin < 1:
                        for f, x in rows[i].items():
                            w[f] += self.rate * y * x
                        b += self.rate * y
            self.weights[c], self.bias[c] = dict(w), b
        return self

    def probabilities(self, row: dict[str, float]) -> dict[str, float]:
        if len(self.weights) == 1:
            return dict.fromkeys(self.weights, 1.0)
        s = {c: sum(w.get(f, 0.0) * x for f, x in row.items()) + self.bias[c] for c, w in self.weights.items()}
        p = {c: 1 / (1 + math.exp(-1.5 * v)) if v > -400 else 0.0 for c, v in s.items()}
        total = sum(p.values())
        return {c: (v / total if total else 1 / len(p)) for c, v in p.items()}

    def predict(self, row: dict[str, float]) -> tuple[str | None, float]:
        p = self.probabilities(row)
        return min(p.items(), key=lambda x: (-x[1], x[0])) if p else (None, 0.0)


def refined(nodes: dict, edges: list[tuple], rounds: int | None = None) -> dict:
    """Colours after repeated hashing of each node's neighbours: equal in isomorphic graphs."""
    colour = dict(nodes)
    for _ in range(rounds if rounds is not None else len(nodes)):
        around = defaultdict(list)
        for a, b, kind in edges:
            around[a].append((">", kind, colour[b]))
            around[b].append(("<", kind, colour[a]))
        nxt = {x: hash((colour[x], tuple(sorted(around[x], key=repr)))) for x in nodes}
        if len(set(nxt.values())) == len(set(colour.values())) and _:
            break
        colour = nxt
    return colour


def _between(edges: list[tuple]) -> dict[tuple, list]:
    """The sorted types of the edges from one node to another."""
    out = defaultdict(list)
    for x, y, kind in sorted(edges, key=repr):
        out[x, y].append(kind)
    return out


def isomorphic(a: tuple[dict, list], b: tuple[dict, list]) -> bool:
    """Typed multigraphs, each (node to its type, edges (from, to, type)): exact, by search over nodes of equal colour."""
    (na, ea), (nb, eb) = a, b
    if len(na) != len(nb) or len(ea) != len(eb):
        return False
    n = len(na)
    ca, cb = refined(na, ea, n), refined(nb, eb, n)
    if sorted(ca.values()) != sorted(cb.values()):
        return False
    da, db = _between(ea), _between(eb)
    options = {x: [y for y in nb if cb[y] == ca[x]] for x in na}
    order = sorted(na, key=lambda x: len(options[x]))

    def place(i: int, to: dict, used: set) -> bool:
        if i == n:
            return True
        x = order[i]
        for y in options[x]:
            if y in used or da.get((x, x), []) != db.get((y, y), []):
                continue
            if all(da.get((x, z), []) == db.get((y, w), []) and da.get((z, x), []) == db.get((w, y), []) for z, w in to.items()):
                to[x] = y
                if place(i + 1, to, used | {y}):
                    return True
                del to[x]
        return False

    return place(0, {}, set())


class Unfinished(RuntimeError):
    """The time that was given is over."""


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, until: float = math.inf) -> tuple[str, float, np.ndarray]:
    """max c x, a x <= b, x >= 0: two phases with Bland's rule. (status, objective, x)"""
    m, n = a.shape
    sign = np.where(b < 0, -1.0, 1.0)
    need = np.flatnonzero(sign < 0)
    t = np.zeros((m + 1, n + m + len(need) + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a * sign[:, None], np.diag(sign), b * sign
    base = [n + i for i in range(m)]
    for j, i in enumerate(need):
        t[i, n + m + j] = 1
        base[i] = n + m + j

    def run(columns: int) -> bool:
        while True:
            if time.monotonic() > until:
                raise Unfinished
            enter = next((j for j in range(columns) if t[-1, j] < -1e-9), None)
            if enter is None:
                return True
            rows = [(t[i, -1] / t[i, enter], base[i], i) for i in range(m) if t[i, enter] > 1e-9]
            if not rows:
                return False
            least = min(r for r, _, _ in rows)
            i = min((x, i) for r, x, i in rows if r <= least + 1e-12)[1]
            t[i] /= t[i, enter]
            for k in range(m + 1):
                if k != i and t[k, enter]:
                    t[k] -= t[k, enter] * t[i]
            base[i] = enter

    if len(need):
        t[-1, n + m : -1] = 1
        for i in need:
            t[-1] -= t[i]
        run(n + m + len(need))
        if t[-1, -1] < -1e-7:
            return "infeasible", math.nan, np.zeros(n)
        for i in range(m):
            if base[i] >= n + m:
                j = next((j for j in range(n + m) if abs(t[i, j]) > 1e-9), None)
                if j is not None:
                    t[i] /= t[i, j]
                    for k in range(m + 1):
                        if k != i:
                            t[k] -= t[k, j] * t[i]
                    base[i] = j
        t[:, n + m : -1] = 0
    t[-1] = 0
    t[-1, :n] = -c
    for i in range(m):
        if base[i] < n and c[base[i]]:
            t[-1] += c[base[i]] * t[i]
    if not run(n + m):
        return "unbounded", math.inf, np.zeros(n)
    x = np.zeros(n + m)
    for i in range(m):
        if base[i] < n + m:
            x[base[i]] = t[i, -1]
    return "optimal", float(c @ x[:n]), x[:n]


def solve(model, seconds: float = math.inf) -> tuple[str, float, dict[str, float]]:
    """A linear or mixed-integer model (modelloom.sources.model.Model) by simplex and branch and bound. Unfinished is raised after so many seconds."""
    until = time.monotonic() + seconds
    columns, shift = [], {}
    for v in model.variables.values():
        lo, hi = v.lower, v.upper
        if lo is None and hi is not None:
            columns.append((v.name, -1.0, hi, None))
        elif lo is None:
            columns += [(v.name, 1.0, 0.0, None), (v.name, -1.0, 0.0, None)]
        else:
            columns.append((v.name, 1.0, lo, None if hi is None else hi - lo))
    sense = -1.0 if model.sense == "min" else 1.0

    def rows_of(extra):
        rows, rhs = [], []

        def add(coefs, comparator, value):
            row = np.array([coefs.get(name, 0.0) * s for name, s, _, _ in columns])
            seen, base = set(), 0.0
            for name, _, at, _ in columns:
                if name not in seen:
                    seen.add(name)
                    base += coefs.get(name, 0.0) * at
            for k in ({"le": 1, "ge": -1}.get(comparator),) if comparator != "eq" else (1, -1):
                rows.append(k * row)
                rhs.append(k * (value - base))

        for r in model.rows:
            add(r.coefs, r.comparator, r.rhs)
        for name, comparator, value in extra:
            add({name: 1.0}, comparator, value)
        for j, (_, _, _, width) in enumerate(columns):
            if width is not None:
                e = np.zeros(len(columns))
                e[j] = 1
                rows.append(e)
                rhs.append(width)
        return np.array(rows).reshape(len(rows), len(columns)), np.array(rhs)

    cost = np.array([sense * model.objective.get(name, 0.0) * s for name, s, _, _ in columns])

    def values(x):
        out: dict[str, float] = {}
        for (name, s, at, _), v in zip(columns, x):
            out[name] = out.get(name, at) + s * v if name in out else at + s * v
        return out

    whole = [v.name for v in model.variables.values() if v.domain in ("integer", "binary")]
    best, todo, first = None, [()], None
    while todo:
        extra = todo.pop()
        status, _, x = simplex(cost, *rows_of(extra), until)
        first = first or status
        if status == "unbounded":
            return "unbounded", math.inf, {}
        if status != "optimal":
            continue
        got = values(x)
        score = sense * sum(model.objective.get(n, 0.0) * v for n, v in got.items())
        if best and score <= best[0] + 1e-9:
            continue
        odd = next((n for n in whole if abs(got[n] - round(got[n])) > 1e-6), None)
        if odd is None:
            best = (score, {n: float(round(v)) if n in whole else v for n, v in got.items()})
        else:
            todo += [(*extra, (odd, "ge", math.floor(got[odd]) + 1)), (*extra, (odd, "le", math.floor(got[odd])))]
    if not best:
        return "infeasible", math.nan, {}
    return "optimal", sum(model.objective.get(n, 0.0) * v for n, v in best[1].items()) + model.constant, best[1]
