"""Mixing beside a plain version."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from data import frame, prose, rows, store
from marginalia.llm import mixing

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(data, weights=(3, 1, 2), share=1.5, epochs=2, seed=mixing.SEED):
    """Targets by rounds of resharing; words by laying a source's rows in order."""
    sizes = defaultdict(int)
    for i, t, _, s, _ in data:
        sizes[s] += len(SIZE.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] >= epochs * sizes[s]}
        if not over:
            target |= level
            break
        target |= {s: epochs * sizes[s] for s in over}
        left, free = left - sum(epochs * sizes[s] for s in over), free - over
    key = lambda i, t: hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15]
    out, at = [], {s: int(target[s] + 0.5) % sizes[s] if sizes[s] else 0 for s in names}
    for i, t, _, s, _ in sorted(data, key=lambda r: key(r[0], r[1])):
        n = len(SIZE.findall(t or ""))
        extra = min(n, at[s])
        at[s] -= extra
        whole = int(target[s] + 0.5) // sizes[s] if sizes[s] else 0
        out.append((i, n, s, sizes[s], round(target[s], 6), whole * n + extra))
    return Counter(out)


@pytest.mark.parametrize("last", [4000, 3])
def test_mix_beside_plain(spark, last):
    data = rows(n=90) + [(500, "one two three four", "en", "hot", 0)] * 70 + [(501, "five six", "en", "hot", 0)] * 3
    got = mixing.mix(frame(spark, data), [3, 1, 2], last=last)
    want = plain(data)
    assert Counter((r.doc_id, r["size"], r.source, r.source_size, round(r.target, 6), r.repeats * r["size"] + r.extra) for r in got.collect()) == want
    taken, target = defaultdict(int), {}
    for (_, _, s, _, t, k), n in want.items():
        taken[s] += k * n
        target[s] = t
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert all(k <= 2 * n for _, n, _, _, _, k in want)


def test_query_and_sql_agree_and_repeat(spark, tmp_path):
    sf = store(spark, tmp_path, documents=frame(spark))
    out = mixing.op11(spark, sf)
    got = Counter(map(tuple, out.collect()))
    assert got == Counter(map(tuple, mixing.op11(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    assert got == Counter(con.execute(mixing.SQL).fetchall())


def test_more_weight_than_words_and_missing_weights(spark):
    data = [(i, prose(random.Random(i), 20), "en", "ab"[i % 2], 0) for i in range(10)]
    weights = spark.createDataFrame([("a", 1.0), ("c", 5.0)], "source string, weight double")
    got = {r.source: r for r in mixing.mix(frame(spark, data), weights).collect()}
    assert got["a"].target == 2 * got["a"].source_size and got["a"].repeats == 2 and got["b"].target == 0 == got["b"].repeats
    assert mixing.mix(frame(spark, data).limit(0), [1]).count() == 0
    silent = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", "en", "x", 0)]), [1]).collect()
    assert [(r.target, r.repeats, r.extra) for r in silent] == [(0.0, 0, 0)] * 2


def test_mixture_has_the_words_and_keeps_columns(spark):
    data = rows(n=40)
    names = ["size", "source_size", "target", "repeats", "extra", "_source", "_row", "_key", "_doc", "_id", "_time"]
    docs = frame(spark, data).selectExpr("*", *[f"doc_id AS `{n}`" for n in names])
    out = mixing.mixture(docs, [3, 1, 2])
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        assert all(r[n] == r.doc_id for n in names)
        got[r.source] += len(SIZE.findall(r.text or ""))
    for (_, _, s, _, _, k), n in plain(data).items():
        want[s] += k * n
    assert +got == +want
