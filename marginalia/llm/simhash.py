"""SimHash near-duplicates: fingerprints at a Hamming distance of 4 or less link, linked documents form a component.

Segment-popcount embedding: the fingerprint's 64 bits are 32 segments of two bits; a segment's bit count is 0, 1 or 2, and
the 32 counts form a vector. The Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints.
The range join under that bound runs on grids with cells of width one: the 32 coordinates are cut into g groups, and
vectors at distance 4 or less agree wholly on at least g - 4 of them, so there is one grid for every choice of g - 4 groups,
and each fingerprint stands in one cell of every grid. Fingerprints that share a cell are tested by the bound, then exactly.
g only decides how many cells there are and how full; any g finds every link. It follows from the number of different
fingerprints, so that a cell holds few of them by chance.

Equal fingerprints are one node. A cell gives back links that span what is connected in it, not all pairs: small cells are
compared pairwise at once, larger ones by searching from one fingerprint to the next among those not reached yet. A cell of
more than ``CELL`` fingerprints is cut into blocks, and every pair of blocks is a task of its own. Components come from
alternating star contraction with reliable checkpoints.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other; a null doc_id
counts only where a component has no other; repeated rows are one node; an empty table gives no rows; extra columns are kept
by ``first_of_group`` and left out elsewhere.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import add_columns, aside, back, texts
from marginalia.session import cut, ship, stored

SHINGLE, DISTANCE, SEED = 4, 4, 42
CELL = 16_384
PAIRWISE = 256
COPY = 100
EVEN = 0x5555555555555555


def fingerprint(text: str) -> int:
    """Bit-wise majority of the XXH64 of all shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(body, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[:len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(body[i:j], SEED) for i, j in zip(first, last)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns and ``_fp``, the fingerprint as a signed number."""
    def make():
        return lambda batch: [pa.array([fingerprint(t) for t in texts(batch, text)], pa.int64())]

    return add_columns(docs, make, [T.StructField("_fp", T.LongType())], keep)


def groups_for(n: int, distance: int = DISTANCE) -> int:
    """The number of coordinate groups that costs least: a fingerprint's copies, one a grid, and those it meets by chance.

    Two random segments have equal counts with probability 3/8; a copy that is shuffled and sorted costs as much as about
    ``COPY`` comparisons. 15 copies up to ten million fingerprints, 70 at a billion, 126 at ten billion.
    """
    def cost(g: int) -> float:
        grids = comb(g, distance)
        # groups differ in width by one at most: between the widest and the narrowest choice
        widths = sorted((i + 1) * 32 // g - i * 32 // g for i in range(g))
        return grids * (COPY + n / 2 * 0.375 ** (32 - sum(widths[-distance:]) / 2 - sum(widths[:distance]) / 2))

    return min(range(distance + 2, 33), key=cost)


def cells(fps: DataFrame, g: int, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): every fingerprint in its cell of every grid. Two-bit counts of all segments fit one number."""
    groups = [range(i * 32 // g, (i + 1) * 32 // g) for i in range(g)]
    masks = [sum(3 << 2 * s for i in chosen for s in groups[i]) for chosen in combinations(range(g), g - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    right = F.shiftrightunsigned("fp", 1)
    one, two = F.col("fp").bitwiseXOR(right).bitwiseAND(F.lit(EVEN)), F.col("fp").bitwiseAND(right).bitwiseAND(F.lit(EVEN))
    vector = one.bitwiseOR(F.shiftleft(two, 1))
    keys = F.array(*[F.xxhash64(F.lit(i), vector.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    return fps.select(F.explode(keys).alias("key"), "fp")


def near(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether fingerprints are near: first by the Manhattan distance of their vectors, then exactly."""
    x, y = a - ((a >> np.uint64(1)) & np.uint64(EVEN)), b - ((b >> np.uint64(1)) & np.uint64(EVEN))
    # |difference| of two-bit counts, segment by segment: 0, 1 or 2
    same = x ^ y
    low, high = same & np.uint64(EVEN), (same >> np.uint64(1)) & np.uint64(EVEN)
    # counts 1 and 2 differ in both bits but by one; 0 and 2 differ in the high bit only, by two
    bound = np.bitwise_count(low | high).astype(np.int64) + np.bitwise_count(high & ~low)
    out = bound <= distance
    out[out] = np.bitwise_count((a ^ b)[out]) <= distance
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect: every node to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (before == label).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def spanning(members: np.ndarray) -> tuple[list, list]:
    """Links that span one cell: search from each fingerprint among those not reached yet."""
    left, a, b = members, [], []
    queue: list = []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        hit = near(left, np.full(len(left), node))
        if hit.any():
            found = left[hit]
            a.append(found)
            b.append(np.full(len(found), node))
            queue.extend(found)
            left = left[~hit]
    return a, b


def links_in(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole cells; keys are sorted."""
    n = len(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.array([], np.int64)
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    for s, size in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE]):
        more = spanning(np.unique(fps[s:s + size]))
        a, b = a + more[0], b + more[1]
    end = np.repeat(np.where(sizes > PAIRWISE, 0, starts + sizes), sizes)
    index, step, held = np.flatnonzero(end > np.arange(n) + 1), 1, 0
    while len(index):
        x, y = fps[index], fps[index + step]
        hit = near(x, y)
        a.append(x[hit])
        b.append(y[hit])
        held += int(hit.sum())
        if held > 1 << 20:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        step += 1
        index = index[index + step < end[index]]
    if not a:
        return np.array([], np.uint64), np.array([], np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def _link(batches):
    """Sorted (key, fp) rows to links (a, b); members of cells beyond CELL go on as (key, block, a)."""
    def batch_of(a, b, key=None, block=None):
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)),
             none if key is None else pa.array(np.full(n, key)), none if block is None else pa.array(np.full(n, block))],
            names=["a", "b", "key", "block"])

    keys, fps, block = np.array([], np.int64), np.array([], np.uint64), 0
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
        if block and last:
            yield batch_of(fps[:first_end(keys)], None, keys[0], block)
            cutoff = first_end(keys)
            keys, fps, block, last = keys[cutoff:], fps[cutoff:], 0, last - cutoff
        if last:
            whole, part, large = keys[:last], fps[:last], np.zeros(last, bool)
            values, counts = np.unique(whole, return_counts=True)
            for key in values[counts > CELL]:
                own = whole == key
                large |= own
                members = part[own]
                for i in range(0, len(members), CELL):
                    yield batch_of(members[i:i + CELL], None, key, i // CELL)
            a, b = links_in(whole[~large], part[~large])
            if len(a):
                yield batch_of(a, b)
            keys, fps = keys[last:], fps[last:]
        while len(keys) > CELL:  # one cell that fills more than a block already
            yield batch_of(fps[:CELL], None, keys[0], block)
            keys, fps, block = keys[CELL:], fps[CELL:], block + 1
    if block:
        yield batch_of(fps, None, keys[0], block)
    elif len(keys):
        a, b = links_in(keys, fps)
        if len(a):
            yield batch_of(a, b)


def first_end(keys: np.ndarray) -> int:
    return int(np.searchsorted(keys, keys[0], "right"))


def links(fps: DataFrame, g: int | None = None) -> DataFrame:
    """(a, b): links that connect what distance 4 or less connects; ``fps`` has each fingerprint ``fp`` once."""
    spark = fps.sparkSession
    ship(spark)
    schema = "a long, b long, key long, block long"
    placed = cells(fps, g or groups_for(fps.count()))
    found = stored(placed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, schema), "links")
    small = found.where("b IS NOT NULL").select("a", "b")
    large = found.where("b IS NULL")
    blocks = large.groupBy("key").agg(F.max("block").alias("_last"))
    meet = large.join(blocks, "key").select("key", "block", "a", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("other")) \
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.col("a").alias("fp")).distinct()
    met = meet.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long")
    return small.unionByName(met)


def _meet(batches):
    """Two blocks of a cell, at most 2 * CELL fingerprints, are one key."""
    keys, fps = np.array([], np.int64), np.array([], np.uint64)

    def out(keys, fps):
        a, b = links_in(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys):
            last = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield out(keys, fps)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by alternating large and small stars."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def grouped(rows: DataFrame) -> DataFrame:
    """(_fp, component_id, first_row) of every fingerprint of ``rows`` (doc_id, _row, _fp)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    nodes = stored(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("first")), "fingerprints")
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    first = joined.groupBy("root").agg(F.min("first").alias("least"))
    return joined.join(first, "root").select(F.col("fp").alias("_fp"), F.col("least.id").alias("component_id"), F.col("least.row").alias("first_row"))


def first_of_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns, whatever their names.

    The slim list of first rows meets the documents on the row's number, which is unique.
    """
    own, names = aside(docs)
    rows = stored(fingerprints(own, names[text]).withColumn("_row", F.monotonically_increasing_id()), "simhash")
    first = grouped(rows.select(F.col(names["doc_id"]).alias("doc_id"), "_row", "_fp")).select(F.col("first_row").alias("_row")).distinct()
    return back(rows.join(first, "_row", "left_semi"), names)


def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = stored(fingerprints(docs, keep=["doc_id"]).withColumn("_row", F.monotonically_increasing_id()), "simhash")
    return rows.join(grouped(rows), "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
