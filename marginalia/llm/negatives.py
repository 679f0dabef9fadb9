"""Hard negatives by a multiway hyperplane tree (GNAT) over integer vectors.

A node has a few split points; a row goes to the nearest, so hyperplanes divide the children. For every split point the node
keeps the least and the largest distance to the rows of each sibling subtree. A search for inner products in a window [lo, hi]
is a search in an annulus around the anchor, since d^2 = |a|^2 + |x|^2 - 2s and a subtree's norms are bounded, too; a sibling
whose distance range to any split point does not meet the annulus as seen from there is eliminated with all below it. In the
leaves that are left, every inner product is computed. Results are exact whatever the tree is.

The split points are fitted on a bounded sample of rows; all rows are routed, and ranges and norms are those of all rows. A
leaf's rows lie in chunks of about ``CHUNK``: one table row with ids, labels and a matrix, so a leaf of copies is many chunks.
Anchors, laid out by leaf, travel in blocks to the chunks of the leaves they visit: a block goes once to a group of chunks, with
its rows for each leaf there, and groups are a few per core, so what is shuffled grows with the anchors, not with anchors times
leaves. Neither side is broadcast. Positives: first the anchor's own leaf, whose k-th best score bounds the annulus for the
others. Negatives: the hull of the windows of the anchor's positives. A task keeps the best of each anchor and window over its
chunks and never holds more than ``HELD`` of them.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors end in
zeros; an empty vector is zero; a null id sorts last and is no anchor; repeated rows are rows of their own, and a row is never
its own partner; inner products are exact below 2^63; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import ship, stored

#: Rows on which split points are fitted, and the bytes they may take.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
FANOUT, LEAF, LEAVES = 16, 2048, 4096
CHUNK, ANCHORS, HELD = 4096, 1024, 1 << 20
#: Groups of chunks per core.
GROUPS = 4
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
NONE, ALL = -(1 << 62), 1 << 62


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


@dataclass
class Node:
    """``children``: a node's number, or -1 - a leaf's. ``near``, ``far``: distances of split point i to the rows of child j;
    ``least``, ``most``: squared norms in child j."""

    points: np.ndarray
    children: list[int]
    near: np.ndarray
    far: np.ndarray
    least: np.ndarray
    most: np.ndarray


class Tree:
    """Node 0 is the root; a tree without nodes has one leaf."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, leaves: int = LEAVES, seed: int = 7):
        self.nodes: list[Node] = []
        self.paths: list[list[tuple[int, int]]] = []
        rng, share = np.random.default_rng(seed), rows / max(len(sample), 1)
        leaf = max(leaf, -(-rows // leaves))

        def grow(own: np.ndarray, path: list[tuple[int, int]]) -> int:
            want = min(FANOUT, -(-int(len(own) * share) // leaf))
            points = self._split_points(sample[own], want, rng) if want > 1 else []
            if len(points) < 2:
                self.paths.append(path)
                return -len(self.paths)
            at, k = len(self.nodes), len(points)
            self.nodes.append(Node(points, [], np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf)))
            side = squared(sample[own], points).argmin(axis=1)
            self.nodes[at].children = [grow(own[side == j], [*path, (at, j)]) for j in range(k)]
            return at

        grow(np.arange(len(sample)), [])

    @staticmethod
    def _split_points(rows: np.ndarray, want: int, rng) -> np.ndarray:
        """Candidates far from each other: each next one is the farthest from those chosen; copies are no second choice."""
        pool = rows[rng.choice(len(rows), min(len(rows), 3 * want), replace=False)]
        chosen, away = [0], squared(pool, pool[:1])[:, 0]
        while len(chosen) < want and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(pool, pool[chosen[-1:]])[:, 0])
        return pool[chosen].astype(np.float64)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)

        def down(at: int, rows: np.ndarray) -> None:
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                side = squared(x[rows], self.nodes[at].points).argmin(axis=1)
                for j, child in enumerate(self.nodes[at].children):
                    down(child, rows[side == j])

        if self.nodes:
            down(0, np.arange(len(x)))
        return out

    def ranges_of(self, leaf: int, x: np.ndarray) -> list[tuple]:
        """(node, i, j, least and largest distance, least and largest squared norm) that a leaf's rows give."""
        norm = (x.astype(np.float64) ** 2).sum(axis=1)
        out = []
        for at, j in self.paths[leaf]:
            d = np.sqrt(squared(x, self.nodes[at].points))
            out += [(at, i, j, float(a), float(b), float(norm.min()), float(norm.max())) for i, (a, b) in enumerate(zip(d.min(axis=0), d.max(axis=0)))]
        return out

    def learn(self, ranges: list[tuple]) -> None:
        for at, i, j, near, far, least, most in ranges:
            node = self.nodes[at]
            node.near[i, j], node.far[i, j], node.least[j], node.most[j] = near, far, least, most

    def visits(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """For each leaf that may hold an inner product in [low, high], the rows of ``x`` that have to visit it."""
        x = x.astype(np.float64)
        norm, found = (x * x).sum(axis=1), {}

        def down(at: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if at < 0:
                found[-1 - at] = rows
                return
            node = self.nodes[at]
            d = np.sqrt(squared(x[rows], node.points))[:, :, None]
            with np.errstate(invalid="ignore"):
                inner = norm[rows, None] + node.least - 2 * high[rows, None]
                outer = norm[rows, None] + node.most - 2 * low[rows, None]
                r, s = (np.sqrt(np.maximum(v, 0))[:, None, :] for v in (inner, outer))
                slack = 1e-6 + 1e-9 * d
                meets = (node.far >= np.maximum(d - s, r - d) - slack) & (node.near <= d + s + slack)
                alive = meets.all(axis=1) & (outer >= 0)
            for j, child in enumerate(node.children):
                down(child, rows[alive[:, j]])

        down(0 if self.nodes else -1, np.flatnonzero(low <= high))
        return found


def prepared(rows: DataFrame, vector: Column, vec_id: str = "vec_id", label: str = "label", row_name: str = "_row") -> DataFrame:
    """_row, vec_id, label and the vector's components as integers (``vector``: array of doubles), of rows that take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(label).isNotNull() & vector.isNotNull() & whole).select(
        F.monotonically_increasing_id().alias(row_name), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    flat = np.asarray(column.flatten())
    out = np.zeros((len(sizes), dim), dtype)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def as_binary(x: np.ndarray) -> pa.Array:
    """A row of the matrix as one binary value."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def as_matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def packed(rows: DataFrame, columns: list[str], keys: list[str], most: int) -> DataFrame:
    """Sorted rows as few wide ones: arrays of ``columns`` and all vectors in one binary value, cut where ``keys`` change and
    at ``most`` rows."""
    types_ = dict(rows.dtypes)
    schema = ", ".join([f"{k} {types_[k]}" for k in keys] + [f"{c} array<{types_[c]}>" for c in columns] + ["v binary"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, key = 0, None

        def closed():
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            values = [pa.array([k], whole.schema.field(n).type) for n, k in zip(keys, key)]
            values += [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c)) for c in columns]
            return pa.RecordBatch.from_arrays([*values, pa.array([b"".join(whole.column("v").to_pylist())], pa.binary())], names=[*keys, *columns, "v"])

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            marks = np.zeros(n, bool)
            for k in keys:
                own = batch.column(k).to_numpy(zero_copy_only=False)
                marks[1:] |= own[1:] != own[:-1]
            at = 0
            for end in [*np.flatnonzero(marks).tolist(), n]:
                now = tuple(batch.column(k)[at].as_py() for k in keys)
                if held and now != key:
                    yield closed()
                key = now
                while at < end:
                    take = min(end - at, most - size)
                    held.append(batch.slice(at, take))
                    size, at = size + take, at + take
                    if size == most:
                        yield closed()
        if held:
            yield closed()

    return rows.select(*keys, *columns, "v").mapInArrow(run, schema)


def scored(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x.T).astype(np.int64)


def windows_in(scores: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, window, place): the first k allowed places of each window [low, high], highest score first, then by place."""
    rows, wins, places = [], [], []
    hull = allowed & (scores >= low.min(axis=1, initial=ALL)[:, None]) & (scores <= high.max(axis=1, initial=NONE)[:, None])
    at, place = np.nonzero(hull)
    order = np.lexsort((place, -scores[at, place], at))
    at, place = at[order], place[order]
    value = -scores[at, place]
    bounds = np.searchsorted(at, np.arange(len(scores) + 1))
    for a in np.flatnonzero(np.diff(bounds)).tolist():
        own = value[bounds[a]:bounds[a + 1]]
        begin, end = np.searchsorted(own, -high[a], "left"), np.searchsorted(own, -low[a], "right")
        for w in np.flatnonzero(end > begin).tolist():
            got = place[bounds[a] + begin[w]:bounds[a] + min(end[w], begin[w] + k)]
            rows.append(np.full(len(got), a))
            wins.append(np.full(len(got), w))
            places.append(got)
    none = [np.array([], np.int64)]
    return np.concatenate(rows or none), np.concatenate(wins or none), np.concatenate(places or none)


def firsts(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, window, -score, missing id, id, row), the first k of each anchor and window."""
    found = found[:, np.lexsort(found[::-1])]
    head = np.flatnonzero(np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0))) if found.shape[1] else np.array([], np.int64)
    number = np.arange(found.shape[1]) - np.repeat(head, np.diff(np.append(head, found.shape[1])))
    return found[:, number < k]


FOUND = "anchor long, `window` int, score long, vec_id long, _row long"


@dataclass
class Forest:
    """The routed rows, their chunks, the tree and how many parts each leaf has."""

    rows: DataFrame
    chunks: DataFrame
    tree: Tree
    parts: dict[int, int]
    dim: int
    dtype: str

    @property
    def grouped(self) -> tuple[list[int], int]:
        """A chunk's number is its leaf's first one plus its part; as many with neighbouring numbers make up a group."""
        first = np.cumsum([0] + [self.parts.get(i, 0) for i in range(len(self.tree.paths))]).tolist()
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        return first, max(1, -(-first[-1] // max(1, int(GROUPS * cores))))

    @classmethod
    def grown(cls, rows: DataFrame, leaf: int = LEAF, chunk: int = CHUNK, sample: int = SAMPLE) -> Forest:
        spark = rows.sparkSession
        ship(spark)
        rows = stored(rows, "vectors")
        n, dim, peak = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)),
                                F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0))).first()
        bound = max(dim, 1) * peak * peak
        dtype = "<f4" if bound < 1 << 24 else "<f8" if bound < 1 << 53 else "<i8"
        take = max(1, min(sample, SAMPLE_BYTES // (8 * max(dim, 1))))
        place = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 33)
        head = rows.where(place < F.lit(int((1 << 31) * min(1.0, take / max(n, 1))))).select("v").limit(2 * take).toArrow()["v"].combine_chunks()
        head = head if isinstance(head, pa.Array) else pa.concat_arrays(head.chunks) if head.num_chunks else pa.array([], pa.list_(pa.int64()))
        tree = Tree(matrix(head, dim, dtype), n, leaf)
        sent = spark.sparkContext.broadcast(tree)

        def route(batches):
            for batch in batches:
                x = matrix(batch.column("v"), dim, dtype)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("vec_id"), batch.column("label"), pa.array(sent.value.leaf_of(x)), as_binary(x)],
                    names=["_row", "vec_id", "label", "leaf", "v"])

        routed = stored(rows.select("_row", "vec_id", "label", "v").mapInArrow(route, "_row long, vec_id long, label long, leaf int, v binary"), "routed")
        parts = {r[0]: -(-r[1] // chunk) for r in routed.groupBy("leaf").count().collect()}
        of = F.array(*[F.lit(parts.get(i, 1)) for i in range(len(tree.paths))])
        dealt = routed.withColumn("part", F.pmod(F.xxhash64("_row"), F.get(of, F.col("leaf"))).cast("int")) \
            .repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("vec_id").asc_nulls_last(), "_row")
        chunks = stored(packed(dealt, ["_row", "vec_id", "label"], ["leaf", "part"], 4 * chunk), "chunks")

        def measure(batches):
            for batch in batches:
                out = [r for i in range(len(batch)) for r in sent.value.ranges_of(
                    batch.column("leaf")[i].as_py(), np.frombuffer(batch.column("v")[i].as_py(), dtype).reshape(-1, dim))]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("node", "i", "j", "near", "far", "least", "most"), r)) for r in out],
                    pa.schema([(c, pa.int32()) for c in ("node", "i", "j")] + [(c, pa.float64()) for c in ("near", "far", "least", "most")]))

        ranges = chunks.mapInArrow(measure, "node int, i int, j int, near double, far double, least double, most double")
        tree.learn([tuple(r) for r in ranges.groupBy("node", "i", "j").agg(F.min("near"), F.max("far"), F.min("least"), F.max("most")).collect()])
        return cls(routed, chunks, tree, parts, dim, dtype)

    def search(self, anchors: DataFrame, k: int, same: bool, own: bool | None = None) -> DataFrame:
        """``FOUND`` of ``anchors`` (_row, label, leaf, v, low, high: bounds of each window): the first k rows of the same or of
        another label in each window. ``own``: only the anchor's leaf (True), only the others (False), or all."""
        spark, dim, dtype = anchors.sparkSession, self.dim, self.dtype
        blocks = packed(anchors.repartitionByRange("leaf", "_row").sortWithinPartitions("leaf", "_row"), ["_row", "label", "leaf", "low", "high"], [], ANCHORS)
        first, width = self.grouped
        sent = spark.sparkContext.broadcast((self.tree, self.parts, first))

        def send(batches):
            tree, parts, first = sent.value
            for batch in batches:
                for i in range(len(batch)):
                    row, label, leaf, low, high = (batch.column(c)[i].values for c in ("_row", "label", "leaf", "low", "high"))
                    x = np.frombuffer(batch.column("v")[i].as_py(), dtype).reshape(-1, dim)
                    at = np.asarray(leaf)
                    if own:
                        visits = {int(v): np.flatnonzero(at == v) for v in np.unique(at)}
                    else:
                        lows, highs = (np.asarray(c.flatten()).reshape(len(at), -1) for c in (low, high))
                        valid = lows <= highs
                        lo = np.where(valid, lows, ALL).min(axis=1, initial=ALL).astype(np.float64)
                        hi = np.where(valid, highs, NONE).max(axis=1, initial=NONE).astype(np.float64)
                        visits = tree.visits(x, np.where(lo <= NONE, -np.inf, lo), np.where(hi >= ALL, np.inf, hi))
                        if own is False:
                            visits = {v: rows[at[rows] != v] for v, rows in visits.items()}
                    groups: dict[int, list[int]] = {}
                    for v in sorted(v for v, rows in visits.items() if len(rows) and v in parts):
                        for g in range(first[v] // width, (first[v] + parts[v] - 1) // width + 1):
                            groups.setdefault(g, []).append(v)
                    for g, leaves in groups.items():
                        rows = np.unique(np.concatenate([visits[v] for v in leaves]))
                        taken, bytes_ = pa.array(rows), x[rows].tobytes()
                        values = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c.take(taken)) for c in (row, label, low, high)]
                        at_leaf = pa.array([[np.searchsorted(rows, visits[v]).astype(np.int32) for v in leaves]], pa.list_(pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([g], pa.int32()), pa.array([leaves], pa.list_(pa.int32())), at_leaf, *values, pa.array([bytes_], pa.binary())],
                            names=["group", "leaves", "at_leaf", "a_row", "a_label", "low", "high", "a_v"])

        visits = blocks.mapInArrow(
            send, "group int, leaves array<int>, at_leaf array<array<int>>, a_row array<long>, a_label array<long>, low array<array<long>>, high array<array<long>>, a_v binary")

        def answer(batches):
            held, size = [], 0

            def out(found):
                anchor, window, score, missing, ids, rows = found
                return pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(-score), pa.array(ids, mask=missing.astype(bool)), pa.array(rows)],
                    names=["anchor", "window", "score", "vec_id", "_row"])

            for batch in batches:
                for i in range(len(batch)):
                    place = np.flatnonzero(np.asarray(batch.column("leaves")[i].values) == batch.column("leaf")[i].as_py())
                    if not len(place):
                        continue
                    rows = np.asarray(batch.column("at_leaf")[i][int(place[0])].values)
                    a_row, a_label, row, label = (np.asarray(batch.column(c)[i].values) for c in ("a_row", "a_label", "_row", "label"))
                    ids = batch.column("vec_id")[i].values
                    missing, ids = np.asarray(ids.is_null()).astype(np.int64), np.asarray(ids.fill_null(0))
                    low, high = (np.asarray(batch.column(c)[i].values.flatten()).reshape(len(a_row), -1) for c in ("low", "high"))
                    a, x = (np.frombuffer(batch.column(c)[i].as_py(), dtype).reshape(-1, dim) for c in ("a_v", "v"))
                    if not dim:
                        a, x = np.zeros((len(a_row), 1)), np.zeros((len(row), 1))
                    a_row, a_label, low, high, a = a_row[rows], a_label[rows], low[rows], high[rows], a[rows]
                    scores = scored(a, x)
                    allowed = (a_label[:, None] == label) & (a_row[:, None] != row) if same else a_label[:, None] != label
                    at, window, place = windows_in(scores, allowed, low, high, k)
                    held.append(np.stack([a_row[at], window, -scores[at, place], missing[place], ids[place], row[place]]))
                    size += len(at)
                    if size > HELD:
                        held = [firsts(np.concatenate(held, axis=1), k)]
                        size = held[0].shape[1]
                        if size > HELD // 2:
                            yield out(held[0])
                            held, size = [], 0
            if held:
                yield out(firsts(np.concatenate(held, axis=1), k))

        number = F.get(F.array(*[F.lit(n) for n in first]), F.col("leaf")) + F.col("part")
        chunks = self.chunks.withColumn("group", F.floor(number / width).cast("int"))
        # Spark takes the visits for as small as the anchors and would send them through the driver; the work is in the pairs, not in
        # the bytes, so the number of tasks is given, with room for groups to fall apart
        tasks = 4 * -(-first[-1] // width) or 1
        return visits.repartition(tasks, "group").join(chunks.repartition(tasks, "group").hint("merge"), "group").select(
            "leaves", "at_leaf", "a_row", "a_label", "low", "high", "a_v", "leaf", "_row", "vec_id", "label", "v").mapInArrow(answer, FOUND)


def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
          leaf: int = LEAF, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows of ``prepared`` on which
    ``anchor`` holds) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    that score from ``low`` to ``high`` hundredths of the positive's score."""
    forest = Forest.grown(rows, leaf, chunk, sample)
    anchors = stored(forest.rows.where(anchor), "anchors")
    one = lambda value: F.array(value.cast("long"))
    first = stored(top(forest.search(anchors.withColumns({"low": one(F.lit(NONE)), "high": one(F.lit(ALL))}), positives, True, True), ["anchor"], positives), "found")
    bar = first.where(F.col("rank") == positives).select(F.col("anchor").alias("_row"), F.col("score").alias("_bar"))
    open_ = anchors.join(bar, "_row", "left").withColumns({"low": one(F.coalesce("_bar", F.lit(NONE))), "high": one(F.lit(ALL))}).drop("_bar")
    more = forest.search(open_, positives, True, False)
    pairs = stored(top(first.drop("rank").unionByName(more), ["anchor"], positives), "positives")
    # window w belongs to the positive of rank w + 1; a negative score has none
    inside = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: F.when(p["score"] >= 0, p["score"]))
    windows = pairs.groupBy(F.col("anchor").alias("_row")).agg(inside.alias("_scores"))
    fill = F.array_repeat(F.lit(None).cast("long"), positives)
    asked = anchors.join(windows, "_row").withColumn("_scores", F.slice(F.concat("_scores", fill), 1, positives)).withColumns({
        "low": F.expr(f"transform(_scores, s -> coalesce(({low} * s + 99) div 100, {ALL}))"),
        "high": F.expr(f"transform(_scores, s -> coalesce({high} * s div 100, {NONE}))")}).drop("_scores")
    hard = top(forest.search(asked, negatives, False), ["anchor", "window"], negatives)
    ids = anchors.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    known = pairs.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(known, ["anchor", "window"]).join(ids, "anchor") \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(vectors.withColumn("label", label), F.transform("embedding", lambda x: x.cast("double") * 256))
    return mined(rows, F.col("vec_id") % 50 == 0)


#: The same by all inner products of the anchors.
SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT a.vec_id AS anchor_id, a.label = x.label AS same, x.vec_id, list_inner_product(a.v, x.v)::bigint AS score
  FROM r a, r x WHERE a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM a WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN (SELECT * FROM a WHERE NOT same) USING (anchor_id)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
