"""A wavelet matrix of token ids in one compressed file: access, counting and occurrence lookup from its bit planes.

File: the magic bytes, then a zstd-compressed header (JSON) with the length of each later section,
then the sections, each compressed by itself: document ids, document ends, and for each bit from the
highest down a plane of bits (lowest first in a byte) followed by the ones before each 512 bits.
A plane's zeros go first, in order, into the next plane; then its ones. Sections are read when asked for.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC, BLOCK = b"WVMX\x01", 512
#: Places that are put in order at once, so that they stay in the processor's cache.
PLACES = 1 << 15


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _places(one: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, places of zeros from there, places of ones from there) for each few blocks of a plane."""
    for first in range(0, len(one), PLACES):
        bits = one[first : first + PLACES]
        yield first, np.flatnonzero(~bits), np.flatnonzero(bits)


def encode(ids: np.ndarray, doc_ids: list, ends: np.ndarray, bits: int) -> bytes:
    """ids of all documents, one after another; ends: the end of each document in them."""
    a = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
    sections, zeros = [json.dumps(doc_ids).encode(), np.asarray(ends, "<u8").tobytes()], []
    for level in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << level)) != 0
        packed = np.packbits(one, bitorder="little")
        padded = np.zeros(-(-len(a) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        sections += [packed.tobytes(), before.tobytes()]
        zeros.append(int(len(a) - before[-1]))
        down, zero, other = np.empty_like(a), 0, zeros[-1]
        for first, low, high in _places(one):
            of = a[first : first + PLACES]
            down[zero : zero + len(low)], down[other : other + len(high)] = of[low], of[high]
            zero, other = zero + len(low), other + len(high)
        a = down
    sections = [_pack(s) for s in sections]
    header = _pack(json.dumps({"tokens": len(a), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "sections": [len(s) for s in sections]}).encode())
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


class WaveletMatrix:
    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n = struct.unpack("<I", data[5:9])[0]
        h = json.loads(self._unpack(data[9 : 9 + n]))
        self.tokens, self.docs, self.bits, self.zeros = h["tokens"], h["docs"], h["bits"], h["zeros"]
        self._data, self._at = data, 9 + n + np.concatenate([[0], np.cumsum(h["sections"])])
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _unpack(data: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)

    def _section(self, i: int) -> bytes:
        return self._unpack(self._data[self._at[i] : self._at[i + 1]])

    def doc_ids(self) -> list:
        return json.loads(self._section(0))

    def ends(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<u8").astype(np.int64)

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(packed bits, ones before each block) of the plane, 0 the highest bit."""
        if level not in self._planes:
            self._planes[level] = np.frombuffer(self._section(2 + 2 * level), np.uint8), np.frombuffer(self._section(3 + 2 * level), "<u4")
        return self._planes[level]

    def _ones(self, level: int, i: int) -> int:
        """Number of ones before position i."""
        packed, before = self._plane(level)
        block = i // BLOCK
        part = packed[block * BLOCK // 8 : i // 8]
        tail = int(packed[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(before[block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the token is before position i."""
        if token >> self.bits:
            return 0
        lo = 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, i)
            lo, i = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, i - b)
        return i - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit."""
        packed, before = self._plane(level)
        totals = before.astype(np.int64) if bit else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(totals, k, "right")) - 1
        bits = np.unpackbits(packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - totals[block]])

    def select(self, token: int, k: int) -> int:
        """The position of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo = 0
        for level in range(self.bits):
            a = self._ones(level, lo)
            lo = self.zeros[level] + a if token >> (self.bits - 1 - level) & 1 else lo - a
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def all(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        a = np.zeros(self.tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._plane(level)[0], bitorder="little", count=self.tokens).view(bool)
            a[self.zeros[level] :] |= a.dtype.type(1 << (self.bits - 1 - level))
            up, zero, other = np.empty_like(a), 0, self.zeros[level]
            for first, low, high in _places(one):
                to = up[first : first + PLACES]
                to[low], to[high] = a[zero : zero + len(low)], a[other : other + len(high)]
                zero, other = zero + len(low), other + len(high)
            a = up
        return a
