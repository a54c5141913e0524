"""Words and word hashes of whole Arrow batches of texts, as arrays: no Python code runs per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    up, down = np.full(n, U64(_BASE)), np.full(n, U64(_INVERSE))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 20, 1 << max(0, n - 1).bit_length()))


#: A random value for each byte.
_BYTES = mixed(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows and the end) of runs of rows with about `most` bytes; a longer text is a run of its own. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with a space after each, so that the last word of one and the first of the next share no place."""
    return np.insert(data, offsets[1:], 32), offsets + np.arange(len(offsets))


#: ASCII letters in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII letters and all bytes of other characters; the same with digits.
LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
ITEM = LETTER | np.array([48 <= b < 58 for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; words are what ASCII white space leaves, or runs of the bytes that kind marks."""
    solid = (data != 32) & ((data < 9) | (data > 13)) if kind is None else kind[data]
    edge = np.ones(len(data) + 1, bool)  # nothing before, or white space, or another row
    edge[1:-1] = ~solid[:-1]
    edge[offsets] = True
    start = np.flatnonzero(solid & edge[:-1])
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = ~solid
    edge[offsets] = True
    end = np.flatnonzero(solid & edge[1:]) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def byte_sums(data: np.ndarray) -> np.ndarray:
    """What part_hashes needs of the bytes."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))


#: Longer words are hashed one by one: sums modulo 2^64 have known collisions from 1024 bytes on.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = part_hashes(byte_sums(data), start, end)
    for i in np.flatnonzero(end - start > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words with one space after each, start and end of each word in them). Words: as word_spans finds them, all of them."""
    n = end - start
    stop = np.cumsum(n + 1) - 1
    out = np.full(int(stop[-1]) + 1 if len(n) else 0, 32, np.uint8)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(stop - n, n) + within] = data[np.repeat(start, n) + within]
    return out, stop - n, stop


def run_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words, over ends of rows too."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mixed(hashes + U64(seed)) * up[: len(hashes)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """For each i up to the last full run: where the least of values[i : i + width] is, the first of equals."""
    at, span = np.arange(len(values)), 1
    if len(values) < width:
        return at[:0]
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys, from batches that are sorted by key: no more is held than a batch and a key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1]["key"][-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
