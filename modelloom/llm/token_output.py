"""Token ids as wavelet matrix shards.

Texts are encoded with the tokenizers library; a document is its ids and the end id. Documents are
sorted by doc_id over the cluster; each task cuts its run into shards of about `shard_tokens` ids and
returns each as one compressed file (wavelet.py). The files are the `file` column of a Parquet table
in the shared folder, a row for each, so any store that Spark writes to can hold them and a task that
is run again leaves no trace of its first run. export() copies them out as plain files.

A byte-level vocabulary splits a text before a space between two characters that are not white
space, around a single line end between such characters, and between letters and marks, in whichever
context. So the pieces between such places are encoded once and their ids kept. Pieces are found,
looked up and put together as bytes, many at a time: one of up to SHORT bytes is known by those bytes
in two integers, so that no two are taken for each other. At most about twice `most_kept` pieces
are in a worker, none longer than LONGEST bytes, and in each lot of texts only those that are new to
the worker are encoded. Other vocabularies are refused.

Null text is the empty text: the end id alone. Null doc_ids come first; rows of one doc_id are
ordered by text. An empty table gives no file. Other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.llm.common import saved
from modelloom.llm.wavelet import WaveletMatrix, encode

END, SHARD_TOKENS, MOST_KEPT = 2, 1 << 20, 600_000
#: Bytes of text that are cut into pieces at once; no piece of over LONGEST bytes is kept, the bytes of one of up to SHORT are its key.
AT_ONCE, LONGEST, SHORT = 1 << 20, 256, 15
#: Letters, then marks: encoded apart, whatever is around them.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&*#|]*)")
#: A piece that the vocabulary's pattern takes whole, as bytes.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_SAFE = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: Of each byte: 0 in a letter, 1 a mark, 2 anything else. Bytes after the first of a character count as letters; 2 for the first tells.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 195]] = 0
_KIND[list(b".,;:!?%$&*#|")] = 1
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
#: White space of more than one byte.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_encoders: dict[tuple, "Encoder"] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def checked(model: str) -> str:
    """The vocabulary's JSON. Refuses one that could tell by more than its neighbours where a run ends: it must be byte-level BPE and nothing else."""
    v = json.loads(model)
    cut = v.get("pre_tokenizer") or {}
    plain = not v.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    plain &= v["model"]["type"] == "BPE" and not any(v["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or _WORD.fullmatch(t["content"]) for t in v["added_tokens"])
    if not plain:
        raise ValueError("vocabulary: byte-level BPE with the usual pattern, without normalizer or prefix space")
    return model


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next of those from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids. What a piece is encoded to is kept, as a part of one array of ids.

    Short pieces are found by hashing with open addressing, in arrays; the longer ones by a dict.
    """

    def __init__(self, model: str, most_kept: int = MOST_KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most_kept = Tokenizer.from_str(checked(model)), most_kept
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        # The same model without the pattern, for words that the pattern takes whole: a line each, in byte letters.
        self.letters = _byte_letters()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "removed")
        vocab = self.bare.get_vocab(with_added_tokens=False)
        #: Bytes of each id. Those of a word's ids add up to the word, as no byte is unknown.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        self.width[list(vocab.values())] = [len(x) for x in vocab]
        self.whole = all(x in vocab for x in self.letters.values())
        self._clear()

    def _clear(self) -> None:
        self.ids, self.used, self.places = np.zeros(1 << 16, self.dtype), 0, 0
        self.at, self.n, self.hits = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.low, self.high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.slots = np.full(1 << 13, -1, np.int32)
        self.long: dict[bytes, int] = {}
        # Place 0: no ids. No short piece has its key.
        self._add(np.zeros(0, self.dtype), np.zeros(1, np.int64))

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds parts of these sizes to the array; their places."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.places + len(sizes) > len(self.at):
            self.at, self.n, self.hits, self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.hits, self.low, self.high))
        place = np.arange(self.places, self.places + len(sizes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[place], self.n[place], self.hits[place] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used, self.places = self.used + len(flat), self.places + len(sizes)
        return place

    def _ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these parts one after another, the size of each part)."""
        n = self.n[places].astype(np.int64)
        ends = np.cumsum(n)
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.at[places] - ends + n, n)], n

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the search for a key begins."""
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The places of these keys, -1 where there is none."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        # Slot by slot, for those whose slot holds another key.
        left = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            out[left] = got = self.slots[slot[left]]
            left = left[(got >= 0) & ((self.low[got] != low[left]) | (self.high[got] != high[left]))]
        return out.astype(np.int64)

    def _enter(self, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Makes these places known by their keys, which are distinct and new."""
        self.low[place], self.high[place] = low, high
        if 2 * self.places > len(self.slots):
            known = np.concatenate([self.slots[self.slots >= 0], place])
            self.slots = np.full(1 << (4 * self.places).bit_length(), -1, np.int32)
            place, low, high = known, self.low[known], self.high[known]
        slot = self._slot(low, high)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            left = self.slots[slot] != place
            place, slot = place[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces that aren't kept yet; their places. Words that the pattern takes whole are encoded in one go."""
        words = [bool(self.whole and _PLAIN.fullmatch(x)) for x in pieces]
        place = np.zeros(len(pieces), np.int64)
        own = [x for x, w in zip(pieces, words) if w]
        if own:
            lines = b"\n".join(own).decode("latin-1").translate(self.letters)
            flat = np.array(self.bare.encode_batch_fast([lines], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum([len(x) for x in own])) + 1
            place[words] = self._add(flat, np.diff(ends, prepend=0))
        rest = [x.decode() for x, w in zip(pieces, words) if not w]
        if rest:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            place[~np.array(words)] = self._add(np.fromiter(chain.from_iterable(got), self.dtype), np.array([len(x) for x in got], np.int64))
        return place

    def _trim(self) -> None:
        """Of too many pieces, those stay that were met in more than one lot of texts: the ones met in most lots, as far as there is room."""
        if self.places <= 2 * self.most_kept and self.used <= 16 * self.most_kept:
            return
        short, names = self.slots[self.slots >= 0].astype(np.int64), list(self.long)
        places = np.concatenate([short, np.array([self.long[x] for x in names], np.int64)])
        order = np.argsort(-self.hits[places], kind="stable")[: self.most_kept]
        order = order[(self.hits[places[order]] > 1) & (np.cumsum(self.n[places[order]], dtype=np.int64) <= 8 * self.most_kept)]
        order.sort()
        own, far = short[order[order < len(short)]], order[order >= len(short)] - len(short)
        (flat, n), low, high = self._ids(places[order]), self.low[own], self.high[own]
        self._clear()
        place = self._add(flat, n)
        self._enter(place[: len(own)], low, high)
        self.long.update(zip([names[i] for i in far.tolist()], place[len(own) :].tolist()))

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(the texts' bytes, with a byte before each and one after all, the start of each piece and the end of the last, each
        text's first byte). The byte before a text is a piece of its own."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = b"\r" + pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar(b"\r", pa.large_binary()))[0].as_buffer().to_pybytes() + b"\r"
        b = np.frombuffer(raw, np.uint8)
        first = np.cumsum(size + 1) - size
        kind, white = _KIND[b], _WHITE[b]
        # Signs that are no letters, though their bytes are alike.
        sign = np.flatnonzero(b == 0xC3)
        kind[sign[np.isin(b[sign + 1], (0x97, 0xB7))]] = 2
        for m in _WIDE.finditer(raw) if (b >= 0xE1).any() or (b == 0xC2).any() else ():
            white[m.start() : m.end()] = True
        cut = np.zeros(len(b), bool)
        cut[1:-1] = ((b[1:-1] == 32) | (b[1:-1] == 10)) & ~white[:-2] & ~white[2:]
        cut[first - 1] = True
        cut[-1] = True
        # Runs from one such place to the next: letters and marks after the first byte, or anything else.
        starts = np.flatnonzero(cut)
        odd = (kind == 2) & ~cut
        odd[1:] |= (kind[:-1] == 1) & (kind[1:] == 0)
        other = np.zeros(len(starts), bool)
        other[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
        other[:-1] |= kind[starts[:-1] + 1] != 0
        marks = np.flatnonzero((kind[:-1] == 0) & (kind[1:] == 1)) + 1
        cut[marks[~other[np.searchsorted(starts, marks, "right") - 1]]] = True
        # A line end, and the byte before a text, apart from what follows.
        cut[starts[:-1][b[starts[:-1]] != 32] + 1] = True
        return raw, np.flatnonzero(cut), first

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, the end of each text's in them)."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if len(texts) > 1 or pc.binary_length(texts)[0].as_py() <= 2 * AT_ONCE:
            return self._encode(texts)
        # One long text, cut where its pieces are.
        text, parts, at = texts[0].as_py(), [], 0
        while at < len(text):
            m = _SAFE.search(text, at + AT_ONCE)
            stop = m.start() if m else len(text)
            parts.append(self._encode(pa.array([text[at:stop]], pa.large_binary()))[0])
            at = stop
        out = np.concatenate(parts)
        return out, np.array([len(out)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, first = self._cut(texts)
        size = np.diff(starts)
        starts = starts[:-1]
        eights = np.ndarray(len(raw) + 8, "<u8", raw + bytes(15), strides=(1,))
        low = eights[starts] & _LOW[np.minimum(size, 8)]
        high = eights[starts + 8] & _LOW[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
        place = self._find(low, high)
        long = np.flatnonzero(size > SHORT)
        longs = [raw[x : x + n] for x, n in zip(starts[long].tolist(), size[long].tolist())]
        place[long] = [self.long.get(x, -1) for x in longs]
        edges = np.searchsorted(starts, first - 1)
        place[edges] = 0
        new = np.flatnonzero((place < 0) & (size <= SHORT))
        new = new[np.lexsort((low[new], high[new]))]
        if len(new):
            fresh = np.append(True, (low[new[1:]] != low[new[:-1]]) | (high[new[1:]] != high[new[:-1]]))
            once = new[fresh]
            got = self._learn([raw[x : x + n] for x, n in zip(starts[once].tolist(), size[once].tolist())])
            self._enter(got, low[once], high[once])
            place[new] = got[np.cumsum(fresh) - 1]
        fresh = list({x for x in longs if x not in self.long})
        if fresh:
            found = dict(zip(fresh, self._learn(fresh).tolist()))
            self.long.update((x, at) for x, at in found.items() if len(x) <= LONGEST)
            place[long] = [found[x] if x in found else self.long[x] for x in longs]
        met = np.zeros(self.places, bool)
        met[place] = True
        self.hits[: self.places] += met
        out, n = self._ids(place)
        self._trim()
        return out, np.cumsum(n)[np.append(edges[1:], len(n)) - 1]


def _encoder(model: str, most_kept: int) -> Encoder:
    key = (hash(model), most_kept)
    if key not in _encoders:
        _encoders[key] = Encoder(model, most_kept)
    return _encoders[key]


def _lots(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about AT_ONCE bytes of text; a longer text is a lot of its own."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b["text"].cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))])
    first = 0
    while first < b.num_rows:
        stop = max(first + 1, int(np.searchsorted(before, before[first] + AT_ONCE, "right")) - 1)
        yield b.slice(first, stop - first)
        first = stop


def _write(model: str, end_id: int, shard_tokens: int, most_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(model, most_kept), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        ids, sizes, parts, held, shard, before = [], [], [], 0, 0, 0

        def flush():
            data = np.concatenate(parts)
            out = encode(data, ids, np.cumsum(sizes), encoder.bits)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before]), pa.array([len(data)]), pa.array([len(ids)]), pa.array([out], pa.binary())], names=["part", "shard", "before", "tokens", "docs", "file"])

        for b in batches:
            for own in _lots(b):
                data, ends = encoder.encode(pc.fill_null(own["text"], ""))
                for doc_id, x, y in zip(own["doc_id"].to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    ids.append(doc_id)
                    parts += [data[x:y], end]
                    sizes.append(y - x + 1)
                    held += sizes[-1]
                    if held >= shard_tokens:
                        yield flush()
                        ids, sizes, parts, shard, before, held = [], [], [], shard + 1, before + held, 0
        if ids:
            yield flush()

    return run


def write_shards(docs: DataFrame, vocabulary_file: str | None = None, end_id: int = END, shard_tokens: int = SHARD_TOKENS, most_kept: int = MOST_KEPT, partitions: int | None = None) -> DataFrame:
    """The written table: part, shard (in that part), before (ids of the part before it), tokens, docs, file. Parts are in doc_id order."""
    spark = docs.sparkSession
    model = checked(Path(vocabulary_file or vocabulary()).read_text(encoding="utf-8"))
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id: an integer")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, shard int, before long, tokens long, docs long, file binary"
    return saved(order.mapInArrow(_write(model, end_id, shard_tokens, most_kept), schema), "shards")


def offsets(shards: DataFrame) -> dict[int, int]:
    """The number of ids before each part: one entry for each of the sort's partitions, a number that is set."""
    totals = {r["part"]: r["tokens"] for r in shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}
    out, at = {}, 0
    for part in sorted(totals):
        out[part] = at
        at += totals[part]
    return out


def _read(start: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, file in zip(b["part"].to_pylist(), b["before"].to_pylist(), b["file"]):
                w = WaveletMatrix(file.as_buffer().to_pybytes())
                ids, ends = w.all().astype("<u4"), w.ends()
                first = ends - np.diff(np.concatenate([[0], ends]))
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(w.doc_ids(), pa.int64()), pa.array(first + before + start[part]), pa.array(ends - first), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    return shards.select("part", "before", "file").mapInArrow(_read(offsets(shards)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> list[str]:
    """Copies the files into a folder that the driver sees, one at a time."""
    paths = []
    for r in shards.orderBy("part", "shard").toLocalIterator():
        paths.append(f"{folder}/part-{r['part']:05d}-{r['shard']:05d}.wvmx")
        Path(paths[-1]).write_bytes(bytes(r["file"]))
    return paths


def token_output(docs: DataFrame, **options) -> DataFrame:
    return read_shards(write_shards(docs, **options))


def open_shard(shards: DataFrame, part: int, shard: int) -> WaveletMatrix:
    return WaveletMatrix(bytes(shards.filter((F.col("part") == part) & (F.col("shard") == shard)).select("file").first()["file"]))
