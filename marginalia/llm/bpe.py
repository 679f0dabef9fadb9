"""Byte-level BPE: encode texts to token ids and decode them again.

A pre-token is looked up in two tiers. First a minimal perfect hash over the vocabulary finds pre-tokens that are
tokens themselves. All others are merged byte by byte: a heap holds the neighbouring pairs by rank, a linked list the
parts that are left. Results of both tiers are remembered per Python worker in two dictionaries of bounded size: when the
young one is full it becomes the old one, whose entries move back as they are met again. That changes no result.

Defined cases: a null or empty text has no tokens; special tokens are ordinary text; decoding the ids gives the bytes
of the text (a lone surrogate, which Spark cannot hold, does not occur). Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marginalia.llm.common import add_columns, texts

#: Entries of each of the two dictionaries in which a worker remembers pre-tokens (about 200 bytes an entry).
MEMORY = 600_000
M64 = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: The codec of this Python worker, kept from task to task.
_OWN: dict[str, Codec] = {}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n slots.

    Keys fall into buckets; each bucket stores the displacement that puts all its keys on free slots, or, for a bucket
    of one key, the slot itself as a negative number. A slot keeps its key, so foreign keys are told apart.
    """

    def __init__(self, table: dict[bytes, int]):
        self.n = len(table)
        self.buckets = max(1, self.n // 2)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [0] * self.n
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in table:
            h = self.hash(key)
            groups[h % self.buckets].append((h, key))
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            group = groups[b]
            if len(group) < 2:
                break
            d = 0
            while True:
                slots = {self.slot(h, d) for h, _ in group}
                if len(slots) == len(group) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, key in group:
                self.put(self.slot(h, d), key, table[key])
        free = iter([s for s in range(self.n) if self.keys[s] is None])
        for b in order:
            if len(groups[b]) == 1:
                s = next(free)
                self.shift[b] = -s - 1
                self.put(s, groups[b][0][1], table[groups[b][0][1]])

    @staticmethod
    def hash(key: bytes) -> int:
        return xxhash.xxh64_intdigest(key)

    def slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & M64
        return (x ^ x >> 31) % self.n

    def put(self, slot: int, key: bytes, value: int) -> None:
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = self.hash(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self.slot(h, d)
        return self.values[s] if self.keys[s] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece that is no token: join the neighbouring pair of least rank, leftmost first, until none is left."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # a part of this pair has been joined since
        end[i], end[j] = stop, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(piece[i:end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def latin_pattern() -> str:
    """The splitting pattern with its classes spelled out for characters below 256, for the faster regex module."""
    chars = list(map(chr, range(256)))
    letter = "".join(c for c in chars if unicodedata.category(c)[0] == "L")
    number = "".join(c for c in chars if unicodedata.category(c)[0] == "N")
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+")


class Pieces(dict):
    """Pre-token to the bytes of its ids (little-endian, 32 bits), filled on demand."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash):
        super().__init__()
        self.ranks, self.whole, self.old = ranks, whole, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode()
            token = self.whole.get(raw)
            ids = [token] if token is not None else merge(raw, self.ranks)
            out = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary, as a task uses it."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str):
        import re

        import regex

        import public_tokenizers

        self.pieces = Pieces(ranks, whole)
        self.split = regex.compile(pattern).findall
        self.split_latin = re.compile(latin_pattern()).findall if pattern == public_tokenizers.PATTERN else self.split
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            found = self.split_latin(text)
        except UnicodeEncodeError:
            found = self.split(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(spark: SparkSession, path: str | None, pattern: str | None):
    """What tasks need to build a codec; the broadcast is as large as the vocabulary file, whatever the input."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    sent = spark.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    used, key = pattern or public_tokenizers.PATTERN, uuid.uuid4().hex

    def codec() -> Codec:
        if key not in _OWN:
            _OWN.clear()
            _OWN[key] = Codec(*sent.value, used)
        return _OWN[key]

    return codec


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns and ``ids`` (binary, little-endian unsigned 32 bits) and ``n_tokens``."""
    codec = _codec(docs.sparkSession, path, pattern)

    def make():
        own = codec()

        def compute(batch):
            ids = [own.encode(t) for t in texts(batch, text)]
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

        return compute

    return add_columns(docs, make, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """All columns and ``decoded`` (binary); null ids decode to no bytes."""
    codec = _codec(rows.sparkSession, path, None)

    def make():
        own = codec()
        return lambda batch: [pa.array([own.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())]

    return add_columns(rows, make, [T.StructField("decoded", T.BinaryType())])


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None,
               with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode, then decode the ids, in one pass; returns digests, and the ids themselves if asked for."""
    codec = _codec(docs.sparkSession, path, pattern)

    def make():
        own = codec()

        def compute(batch):
            ids = [own.encode(t) for t in texts(batch, text)]
            out = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            return out + [pa.array(ids, pa.binary())] * with_ids

        return compute

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return add_columns(docs, make, fields + [T.StructField("ids", T.BinaryType())] * with_ids, keep)


assert sys.byteorder == "little"


def op6(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
