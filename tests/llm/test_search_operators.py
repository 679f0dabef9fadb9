"""Ranked search and hard negatives beside plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import ascii_lower, frame, prose, rows, store
from marginalia.llm import lexical, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(ascii_lower(text or ""))


def plain_rank(data, queries, k=10):
    docs = [(r[0], Counter(terms(r[1]))) for r in data]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


QUERIES = [(1, "river stone amber"), (2, "Éclair STRASSE straße 日本 42"), (3, None), (4, ""), (5, "?!"), (6, "absent"), (6, "copper absent field of of the"),
           (7, " ".join("the of and river stone éclair garden winter amber 42 copper field lantern".split()))]


@pytest.mark.parametrize("docs_a_block, query_bytes", [(2048, 1 << 20), (7, 30)])
def test_ranking_beside_plain(spark, monkeypatch, docs_a_block, query_bytes):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_a_block)
    data = rows(n=200)
    docs = frame(spark, data).selectExpr("*", "doc_id AS n", "text AS terms", "lang AS score").repartition(3)
    queries = spark.createDataFrame(QUERIES, "item_id long, text string").selectExpr("*", "1 AS number")
    got = lexical.ranked(docs, queries, query_bytes=query_bytes)
    assert Counter(map(tuple, got.collect())) == plain_rank(data, QUERIES)


def test_blocks_are_skipped_and_pairs_tighten(spark):
    """In a long row of blocks, pair bounds rule out more blocks than single bounds, and results stay those of all scores."""
    rnd = random.Random(3)
    data = [(i, prose(rnd, rnd.randint(3, 60))) for i in range(3000)]
    vocabulary = [f"w{i}" for i in range(300)]
    data = [(i, t + " " + " ".join(rnd.choices(vocabulary, k=4))) for i, t in data]
    queries = [(q, " ".join(rnd.sample(vocabulary, 6))) for q in range(20)]
    parsed = lexical.Queries.parsed(queries)
    at = {t: i for i, t in enumerate(parsed.terms)}
    counted = [Counter(lexical.words(t.encode())) for _, t in data]
    n = np.array([sum(c.values()) for c in counted])
    df = Counter(at[t] for c in counted for t in c if t in at)
    plan = lexical.Plan.made(parsed, len(data), int(n.sum()), df)
    seen = {}
    for paired in (True, False):
        best, visited = [lexical.Best() for _ in queries], 0
        for begin in range(0, len(data), 50):
            own = [[(at[t], k) for t, k in c.items() if t in at] for c in counted[begin:begin + 50]]
            flat = [x for o in own for x in o]
            block = lexical.block_of([i for i, _ in data[begin:begin + 50]], n[begin:begin + 50], np.append(0, np.cumsum([len(o) for o in own])),
                                     np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), plan)
            place, pair_place = np.full(len(plan.weight), -1), np.full(len(plan.pairs), -1)
            place[block.terms], pair_place[block.pairs] = np.arange(len(block.terms)), np.arange(len(block.pairs))
            for (terms_, pairs), b in zip(plan.of, best):
                visited += lexical.search_block(block, place, pair_place, plan, terms_, pairs if paired else pairs[:0], b, 10)
        seen[paired] = visited
        got = Counter((q, rank, d, s) for (q, _), b in zip(queries, best) for rank, (s, _, d) in enumerate(b.rows, 1))
        assert got == plain_rank(data, queries)
    assert seen[True] < seen[False] < 20 * 60


def test_ranking_of_empty_tables(spark):
    docs, queries = frame(spark), spark.createDataFrame(QUERIES, "item_id long, text string")
    assert lexical.ranked(docs.limit(0), queries).count() == 0 == lexical.ranked(docs, queries.limit(0)).count()


def plain_negatives(data):
    """data: (vec_id, components, label) in the order of rows."""
    kept = []
    for i, v, label in data:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    width = max(len(v) for _, v, _ in kept)
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], dtype=object)
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (i, _, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        score = x.dot(x[a])
        same = sorted((b for b in range(len(kept)) if b != a and kept[b][2] == label), key=lambda b: (-score[b], last(kept[b][0])))[:5]
        for p in same:
            hard = [b for b in range(len(kept)) if kept[b][2] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            hard.sort(key=lambda b: (-score[b], last(kept[b][0])))
            out += [(i, kept[p][0], rank, kept[b][0], score[p], score[b]) for rank, b in enumerate(hard[:3], 1)]
    return Counter(out)


def vectors(seed=1, n=400, dim=6, scale=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dim))
    out = []
    for i in range(n):
        v = (centres[i % 5] + rnd.normal(size=dim) * 0.3) * scale
        out.append((i, [float(x) for x in v], int(rnd.integers(0, 4))))
    same = out[50][1]
    out += [(1000 + i, same, i % 3) for i in range(130)]  # copies
    out += [(2000, None, 1), (2001, [None] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf")] * dim, 1), (2004, same, None),
            (None, same, 1), (2005, [], 1), (2006, [1.0], 2), (2050, [0.0] * dim, 1), (2100, [-x for x in same], 0), (2150, same, 9)]
    return out + out[200:201] * 3


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("leaf, chunk, sample", [(2048, 4096, 20000), (20, 16, 200)])
def test_negatives_beside_plain(spark, tmp_path, leaf, chunk, sample, monkeypatch):
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in vectors()]
    monkeypatch.setattr(negatives, "ANCHORS", 4 if leaf == 20 else 1024)
    monkeypatch.setattr(negatives, "HELD", 50 if leaf == 20 else 1 << 20)
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    prepared = negatives.prepared(table.withColumn("label", label).withColumn("leaf", F.lit(1)), F.transform("embedding", lambda x: x.cast("double") * 256))
    got = negatives.mined(prepared, F.col("vec_id") % 50 == 0, leaf=leaf, chunk=chunk, sample=sample)
    assert Counter(map(tuple, got.collect())) == plain_negatives(data)
    if leaf == 2048:
        sf = store(spark, tmp_path, embeddings=table)
        assert Counter(map(tuple, negatives.op13(spark, sf).collect())) == plain_negatives(data)


def test_large_components_stay_exact(spark):
    data = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in vectors(2, 120, 4, 1e5) if v and None not in v and all(map(math.isfinite, v)) and c is not None]
    prepared = negatives.prepared(spark.createDataFrame(data, SCHEMA), F.transform("embedding", lambda x: x.cast("double") * 256))
    got = negatives.mined(prepared, F.col("vec_id") % 50 == 0)
    want = plain_negatives([(i, v, (c - 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in data])
    assert Counter(map(tuple, got.collect())) == want


def test_no_vectors(spark):
    prepared = negatives.prepared(spark.createDataFrame([], SCHEMA), F.transform("embedding", lambda x: x.cast("double")))
    assert negatives.mined(prepared, F.col("vec_id") % 50 == 0).count() == 0


def test_tree_eliminates_siblings_and_keeps_every_match():
    rnd = np.random.default_rng(4)
    x = np.round((np.repeat(rnd.normal(size=(30, 8)), 100, axis=0) * 5 + rnd.normal(size=(3000, 8)) * 0.2) * 100)
    tree = negatives.Tree(x[::3], len(x), leaf=100)
    leaf = tree.leaf_of(x)
    sums = defaultdict(lambda: [math.inf, -math.inf, math.inf, -math.inf])
    for v in np.unique(leaf).tolist():
        for at, i, j, near, far, least, most in tree.ranges_of(v, x[leaf == v]):
            r = sums[at, i, j]
            sums[at, i, j] = [min(r[0], near), max(r[1], far), min(r[2], least), max(r[3], most)]
    tree.learn([(*k, *v) for k, v in sums.items()])
    scores = x[:50] @ x.T
    top = np.sort(scores, axis=1)[:, -5]
    for low, high in ((top, np.full(50, np.inf)), (top * 0.5, top * 0.95)):
        visits = tree.visits(x[:50], low, high)
        for a in range(50):
            want = {int(v) for v in leaf[(scores[a] >= low[a]) & (scores[a] <= high[a])]}
            assert want <= {v for v, rows_ in visits.items() if a in rows_}
        assert sum(map(len, visits.values())) < 0.7 * 50 * len(tree.paths)
    some = defaultdict(int)
    for v in leaf.tolist():
        some[v] += 1
    assert len(tree.nodes) > 1 and sum(some.values()) == len(x)


@pytest.mark.parametrize("groups", [0.25, 4])
def test_anchors_meet_chunks_without_the_driver(spark, groups, monkeypatch):
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in vectors()]
    monkeypatch.setattr(negatives, "GROUPS", groups, raising=False)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    prepared = negatives.prepared(spark.createDataFrame(data, SCHEMA).withColumn("label", label), F.transform("embedding", lambda x: x.cast("double") * 256))
    forest, plans = negatives.Forest, []
    search = forest.search

    def seen(*args, **kwargs):
        out = search(*args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(forest, "search", seen)
    got = negatives.mined(prepared, F.col("vec_id") % 50 == 0, leaf=20, chunk=16, sample=200)
    assert Counter(map(tuple, got.collect())) == plain_negatives(data)
    assert len(plans) == 3 and not any(re.search(r"BroadcastHashJoin \[(leaf|group)", p) for p in plans)
