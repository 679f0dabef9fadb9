"""Token sequences of equal length, packed best-fit-decreasing.

Texts become ids of a byte-level BPE with an end-of-text id behind each; documents longer than a sequence are cut into
consecutive pieces, so nothing is lost. Pieces are placed longest first, each into the open sequence whose free room fits
it most tightly; a segment tree over free room finds that sequence in logarithmic time. Each output row is one row of the
packed id matrix with its cumulative segment lengths and its positions, which start again at 0 with every segment.

A task packs what it reads, in blocks of ``BLOCK_TOKENS``, so nothing is shuffled, no source or copy can make a task larger
than its input split, and memory is bounded by a block. At a block's end a few sequences stay partly empty; they are padded.

Defined cases: a null or empty text is a piece of one end-of-text id; a null doc_id is kept; repeated rows are packed as
often as they occur and told apart by their number in the block; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import read_ranks
from marginalia.session import ship

LENGTH, BLOCK_TOKENS = 2048, 4_000_000
SEGMENT = "struct<doc_id: long, number: int, piece: int, length: int>"
#: ids and positions: little-endian, two bytes each (four for vocabularies of more than 65,536), ``length`` of them.
PACKED = f"pool int, block int, row int, n_tokens int, segments array<{SEGMENT}>, cumulative array<int>, ids binary, positions binary"
_OWN: dict[str, object] = {}


class Room:
    """Open sequences by free room; a segment tree says where in a range of room there are any."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        i = room + self.leaves
        while i:
            self.any[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with at least ``need`` free, removed; None if there is none."""
        i, some = need + self.leaves, self.any
        while not some[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.leaves:
            i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            some[i] -= 1
            i >>= 1
        return room, self.at[room].pop()


def pack(lengths: list[int], length: int) -> list[list[int]]:
    """Which pieces go into which sequence, best-fit-decreasing; equal pieces keep their order."""
    room, out = Room(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[piece]
        free, at = room.take(size) or (length, len(out))
        if at == len(out):
            out.append([])
        out[at].append(piece)
        if free > size:
            room.put(free - size, at)
    return out


def _rows(block: list, length: int, kind, pad: int):
    """Packed rows of a block of (doc_id, ids)."""
    pieces = [(doc, number, i // length, ids[i:i + length]) for number, (doc, ids) in enumerate(block) for i in range(0, len(ids), length)]
    for row, chosen in enumerate(pack([len(p[3]) for p in pieces], length)):
        sizes = [len(pieces[i][3]) for i in chosen]
        used = sum(sizes)
        ids, positions = np.full(length, pad, kind), np.zeros(length, kind)
        ids[:used] = np.concatenate([pieces[i][3] for i in chosen])
        starts = np.cumsum([0, *sizes])
        positions[:used] = np.arange(used) - np.repeat(starts[:-1], sizes)
        segments = [{"doc_id": pieces[i][0], "number": pieces[i][1], "piece": pieces[i][2], "length": n} for i, n in zip(chosen, sizes)]
        yield row, used, segments, starts.tolist(), ids.tobytes(), positions.tobytes()


def packed(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """PACKED rows; ``ids`` is padded with the end-of-text id, which is the first id behind the vocabulary."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    ranks = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sent, key, pattern = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex, public_tokenizers.PATTERN
    end = max(ranks.values()) + 1
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("number", pa.int32()), ("piece", pa.int32()), ("length", pa.int32())]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), shape, pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["pool", "block", "row", "n_tokens", "segments", "cumulative", "ids", "positions"]

    def run(batches):
        import tiktoken

        if key not in _OWN:
            _OWN.clear()
            _OWN[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        encoding, pool = _OWN[key], TaskContext.get().partitionId()
        last = np.array([end], kind)
        held, size, number = [], 0, 0

        def out():
            rows = [(pool, number, *r) for r in _rows(held, length, kind, end)]
            for at in range(0, len(rows), 2048):
                part = rows[at:at + 2048]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encoding.encode_to_numpy(body or "", disallowed_special=()).astype(kind), last])
                held.append((doc, ids))
                size += len(ids)
                if size >= block_tokens:
                    yield from out()
                    held, size, number = [], 0, number + 1
        if held:
            yield from out()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)


def unpacked(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every document, put together again from its pieces."""
    import public_tokenizers

    spark = rows.sparkSession
    tokens = {rank: token for token, rank in read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    sent, end = spark.sparkContext.broadcast(tokens), max(tokens) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"

    def run(batches):
        table = sent.value
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], kind)
                for s, (a, b) in zip(r["segments"], zip(r["cumulative"], r["cumulative"][1:])):
                    out.append((r["pool"], r["block"], s["number"], s["doc_id"], s["piece"], b"".join(table[i] for i in ids[a:b].tolist() if i != end)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=["pool", "block", "number", "doc_id", "piece", "body"])

    pieces = rows.mapInArrow(run, "pool int, block int, number int, doc_id long, piece int, body binary")
    whole = pieces.groupBy("pool", "block", "number", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "body"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["body"]))
    return whole.select("doc_id", joined.cast("string").alias("text"))


def op1(spark, sf_dir):
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
