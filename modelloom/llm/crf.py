"""A linear-chain conditional random field of two labels over sparse features, in arrays.

Many sequences are one chain: the first item of each has a transition that forgets what was before.
The chain is cut into blocks that are worked on side by side. The product of each block's transfer
matrices, taken first, gives what enters every block, so the marginals are exact for a sequence of
any length, in 3 * BLOCK array steps for a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BLOCK = 256
#: Items that are worked on at once while fitting; a longer sequence is on its own.
PIECE = 1 << 17


@dataclass
class Crf:
    weights: np.ndarray
    bias: float = 0.0
    #: log potentials, from label to label
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Of label 1 over label 0. features: for each item, the indices of its features."""
        out = np.full(len(features), self.bias)
        for j in range(features.shape[1]):
            out += self.weights[features[:, j]]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray, pairs: bool = False):
        """The probability of label 1 for each item; with pairs, also the expected number of each move and start."""
        n = len(scores)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        blocks = -(-n // BLOCK)
        e, f = np.ones(blocks * BLOCK), np.ones(blocks * BLOCK, bool)
        e[:n], f[:n] = np.exp(np.clip(scores, -25, 25)), first
        e, f = np.ascontiguousarray(e.reshape(blocks, BLOCK).T), np.ascontiguousarray(f.reshape(blocks, BLOCK).T)
        m, s = np.exp(self.moves), np.exp(self.starts)
        a00, a10 = np.where(f, s[0], m[0, 0]), np.where(f, s[0], m[1, 0])
        a01, a11 = np.where(f, s[1], m[0, 1]) * e, np.where(f, s[1], m[1, 1]) * e

        p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for t in range(BLOCK):
            p00, p01 = p00 * a00[t] + p01 * a10[t], p00 * a01[t] + p01 * a11[t]
            p10, p11 = p10 * a00[t] + p11 * a10[t], p10 * a01[t] + p11 * a11[t]
            z = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
        into, out = np.empty((blocks, 2)), np.empty((blocks, 2))
        u = v = (0.5, 0.5)
        products = np.stack([p00, p01, p10, p11], 1).tolist()
        for b, (x00, x01, x10, x11) in enumerate(products):
            into[b] = u
            y0, y1 = u[0] * x00 + u[1] * x10, u[0] * x01 + u[1] * x11
            u = (y0 / (y0 + y1), y1 / (y0 + y1))
        for b in range(blocks - 1, -1, -1):
            out[b] = v
            x00, x01, x10, x11 = products[b]
            y0, y1 = x00 * v[0] + x01 * v[1], x10 * v[0] + x11 * v[1]
            v = (y0 / (y0 + y1), y1 / (y0 + y1))

        ahead = np.empty((BLOCK, blocks))
        u0, u1 = into[:, 0], into[:, 1]
        for t in range(BLOCK):
            u0, u1 = u0 * a00[t] + u1 * a10[t], u0 * a01[t] + u1 * a11[t]
            u1 = u1 / (u0 + u1)
            u0 = 1 - u1
            ahead[t] = u1
        behind = np.empty((BLOCK, blocks))
        v0, v1 = out[:, 0], out[:, 1]
        for t in range(BLOCK - 1, -1, -1):
            behind[t] = v1
            v0, v1 = a00[t] * v0 + a01[t] * v1, a10[t] * v0 + a11[t] * v1
            v1 = v1 / (v0 + v1)
            v0 = 1 - v1
        one, zero = ahead * behind, (1 - ahead) * (1 - behind)
        p = (one / (one + zero)).T.ravel()[:n]
        if not pairs:
            return p
        flat = lambda x: x.T.ravel()[:n]
        a, b = flat(ahead), flat(behind)
        inner = ~first
        inner[0] = False
        at = np.flatnonzero(inner)
        left, right = np.stack([1 - a[at - 1], a[at - 1]]), np.stack([1 - b[at], b[at]])
        through = np.stack([flat(a00)[at], flat(a01)[at], flat(a10)[at], flat(a11)[at]]).reshape(2, 2, -1)
        joint = left[:, None] * through * right[None]
        joint /= joint.sum((0, 1))
        begin = p[first]
        return p, joint.sum(2), np.array([(1 - begin).sum(), begin.sum()])


def _pieces(first: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first item, end) of runs of whole sequences, of `most` items at most unless one is longer. No sequence bears on another, so each run is worked on alone."""
    starts = np.r_[np.flatnonzero(first[1:]) + 1, len(first)]
    out, at = [], 0
    while at < len(first):
        end = int(starts[max(np.searchsorted(starts, at + most, "right") - 1, np.searchsorted(starts, at, "right"))])
        out.append((at, end))
        at = end
    return out


def fit(features: np.ndarray, labels: np.ndarray, first: np.ndarray, size: int, rounds: int = 40, rate: float = 0.15, penalty: float = 1e-6) -> Crf:
    """Maximum likelihood by Adam over all items. size: number of possible features."""
    model = Crf(np.zeros(size))
    y, n = labels.astype(float), len(labels)
    if not n:
        return model
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    moved = np.bincount(labels[inner - 1].astype(int) * 2 + labels[inner].astype(int), minlength=4).reshape(2, 2)
    begun = np.bincount(labels[first].astype(int), minlength=2)
    theta = np.zeros(size + 7)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    pieces = _pieces(first, PIECE)
    for k in range(1, rounds + 1):
        grad, expected, starts = np.zeros_like(theta), np.zeros((2, 2)), np.zeros(2)
        for a, b in pieces:
            x = features[a:b]
            p, moves, begins = model.marginals(model.scores(x), first[a:b], pairs=True)
            g = y[a:b] - p
            grad[:size] += np.bincount(x.ravel(), np.repeat(g, x.shape[1]), minlength=size)
            grad[size] += g.sum()
            expected += moves
            starts += begins
        grad[size + 1 :] = np.r_[(moved - expected).ravel(), begun - starts]
        grad /= n
        grad -= penalty * theta
        mean *= 0.9
        mean += 0.1 * grad
        square *= 0.99
        square += 0.01 * grad * grad
        theta = theta + rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
        model = Crf(theta[:size], float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :])
    model.weights = model.weights.astype(np.float32)
    return model
