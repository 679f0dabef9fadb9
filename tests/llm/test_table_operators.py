"""Packing, fingerprints, WARC, shards, near-duplicates and the pipeline beside plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from data import LABELS, ascii_lower, frame, prose, rows, store
from marginalia.llm import bpe, decontaminate, merkle, packing, pii, secret_scan, sharding, simhash, toxicity, warc


def test_packing_places_as_best_fit_decreasing_does():
    rnd = random.Random(1)
    for _ in range(150):
        length = rnd.randint(1, 40)
        sizes = [rnd.randint(1, length) for _ in range(rnd.randint(0, 60))]
        free = []
        for size in sorted(sizes, reverse=True):
            fit = min((f for f in free if f >= size), default=None)
            if fit is not None:
                free.remove(fit)
            free.append((length if fit is None else fit) - size)
        got = packing.pack(sizes, length)
        assert sorted(i for g in got for i in g) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in g) for g in got) == sorted(free)


def test_packing_loses_nothing(spark):
    docs = frame(spark)
    out = packing.packed(docs, length=128, block_tokens=3000)
    back = packing.unpacked(out)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, *_ in rows())
    for r in out.collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 128 and r.cumulative[-1] == r.n_tokens == sum(s.length for s in r.segments)
        for a, b in zip(r.cumulative, r.cumulative[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert (ids[r.n_tokens:] == 50256).all()
    assert packing.packed(docs.limit(0)).count() == 0


def plain_next(data):
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(a, order[(i + 1) % len(order)]) for i, a in enumerate(order)]


def test_fingerprints_follow_the_contract(spark, tmp_path):
    data = [r for r in {r[0]: r for r in rows()}.values()]
    sf = store(spark, tmp_path, documents=frame(spark, data))
    got = {r.doc_id: r for r in merkle.op2(spark, sf).collect()}
    assert len(got) == len(data)
    by_text = defaultdict(set)
    for (doc, text, *_), (_, other, *_) in plain_next(data):
        text, other = text or "", other or ""
        n = len(text)
        edited = text[:n - n // 3] + other[:n // 3]
        assert got[doc].n_chars == n and got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
        by_text[text].add(got[doc].fingerprint)
        by_text[edited].add(got[doc].edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({*map(tuple, by_text.values())}) == len(by_text)


@pytest.mark.parametrize("data", [[], [(5, "alone", None, None, 5)], [(None, f"t{i}", None, None, 2) for i in range(300)] + [(7, "same", None, None, 4)] * 300])
def test_next_with_hot_and_missing_ids(spark, data):
    out = merkle.with_next(frame(spark, data).select("doc_id", "text"), ["text"]).collect()
    assert len(out) == len(data) and all(r.next_text is not None for r in out)
    assert Counter(r.next_text for r in out) == Counter(r[1] for r in data)  # one cycle through all rows


def test_ranges_cut_by_width_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 1)
    ids = [i * i * i - 40_000 for i in range(150)] + [-(1 << 63), (1 << 63) - 1, 7]
    data = [(i, f"text {i}", None, None, 1) for i in ids]
    got = {r.doc_id: r.next_text for r in merkle.with_next(frame(spark, data).select("doc_id", "text"), ["text"]).collect()}
    assert got == {a[0]: b[1] for a, b in plain_next(data)}


def plain_tree(text):
    """Sections as lists of paragraphs."""
    out, own = [], []
    for p in re.findall(r"[^\n]*\n|[^\n]+", text):
        own.append(p)
        if hashlib.sha256(p.encode()).hexdigest()[31] in "0123":
            out.append(own)
            own = []
    return out + [own] if own else out


def plain_edits(a, b):
    """Trim equal ends, pair the n-th copies between; what has no partner was removed or inserted, what changes its rank was moved."""
    pa, pb = ([(p, (s, i)) for s, ps in enumerate(plain_tree(t)) for i, p in enumerate(ps)] for t in (a, b))
    while pa and pb and pa[0][0] == pb[0][0]:
        pa, pb = pa[1:], pb[1:]
    while pa and pb and pa[-1][0] == pb[-1][0]:
        pa, pb = pa[:-1], pb[:-1]

    def numbered(ps):
        seen = Counter()
        out = {}
        for p, at in ps:
            out[p, seen[p]] = at
            seen[p] += 1
        return out

    na, nb = numbered(pa), numbered(pb)
    both = [k for k in na if k in nb]
    there = sorted(both, key=nb.get)
    return ([at for k, at in na.items() if k not in nb], [at for k, at in nb.items() if k not in na], [na[x] for x, y in zip(sorted(both, key=na.get), there) if x != y])


def test_edits_beside_plain_tree(spark):
    rnd = random.Random(11)
    lines = [f"Paragraph {i} says this, and that.\n" for i in range(40)]
    boiler = "All rights reserved.\n"
    spread = [x for i, l in enumerate(lines) for x in ([l, boiler] if i % 3 else [l])]
    pairs = [(lines, lines), (lines, [l.replace("Paragraph 17 says", "Paragraph 17 said") for l in lines]), (lines, lines[:9] + lines[10:]), (lines, lines[:9] + ["new\n"] + lines[9:]),
             (spread, spread[:20] + spread[21:]), ([boiler] * 30, [boiler] * 29), (lines, lines[:5] + lines[20:25] + lines[5:20] + lines[25:]), ([], ["x"]), (["x"], []), ([], []),
             (["a\n", "b\n"] * 4, ["b\n", "a\n"] * 4), (lines, lines[::-1]), (["x" * 5000], ["x" * 4000 + "y" * 1000])]
    pool = lines[:6] + [boiler]
    pairs += [(rnd.choices(pool, k=rnd.randint(0, 12)), rnd.choices(pool, k=rnd.randint(0, 12))) for _ in range(40)]
    data = [("".join(a), "".join(b)) for a, b in pairs]
    df = spark.createDataFrame(data, "a string, b string").selectExpr("*", "a AS _a", "a AS same_", "a AS c0")
    for c in "ab":
        df = merkle.fingerprint(df, c).withColumnRenamed("fingerprint", f"f{c}")
    changed = 0
    for r in merkle.edits(df, "fa", "fb").collect():
        assert r.same == (r.a == r.b) and r._a == r.a == r.c0 == r.same_
        removed, inserted, moved = plain_edits(r.a, r.b)
        got = [[tuple(x) for x in xs] for xs in (r.removed, r.inserted, r.moved)]
        assert got == [sorted(removed), sorted(inserted), moved], (r.a, r.b)
        assert r.same or any(got)
        changed += not r.same
        tree = [[p for p in re.findall("[0-9a-f]+", s)] for s in re.findall("[^/]*/|[^/]+", r.fa.split(":")[1])]
        assert [len(s) for s in tree] == [len(s) for s in plain_tree(r.a)]
        assert [[p[:8] for p in s] for s in tree] == [[hashlib.sha256(p.encode()).hexdigest()[24:32] for p in s] for s in plain_tree(r.a)]
    assert changed > 40
    one = merkle.edits(df.where(F.col("b").contains("17 said")), "fa", "fb").first()
    assert (one.clause.removed, one.clause.inserted) == (2, 1)  # "says" ends a clause


def test_likeness_is_read_from_fingerprints(spark):
    df = frame(spark, rows(n=20)).selectExpr("coalesce(text, '') AS t")
    df = merkle.fingerprint(df, "t")
    near = lambda c: merkle.likeness_of(F.col("fingerprint"), c)
    other = df.select(F.col("fingerprint").alias("o"), F.col("t").alias("u")).limit(5)
    got = df.join(F.broadcast(other)).select(near(F.col("o")).alias("x"), merkle.likeness(merkle.clauses(F.col("t")), merkle.clauses(F.col("u"))).alias("y")).collect()
    assert got and all(r.x == r.y for r in got)


def test_likeness_of_one_line_and_repeated_clauses(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    signs = lambda n: "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(n))
    one = line(300)
    # (text, edited text, unrelated text)
    data = [(t, t[:len(t) - len(t) // 3] + o[:len(t) // 3], o) for t, o in [
        (one, line(300)), (line(12), line(12)), ("spam " * 400, line(300)), ("Buy now. " * 200, line(300)), (signs(900), signs(900)),
        ("x" * 3000, line(300)), (signs(200) + "\u3002" + signs(200), signs(400)), ("y" * 40 + ", z", line(10))]]
    data += [(one, "new words in front " + one, line(300)), (data[4][0], signs(7) + data[4][0], signs(900))]
    df = spark.createDataFrame(data, "own string, edited string, other string")
    got = df.select(merkle.likeness(*map(merkle.clauses, (F.col("own"), F.col("edited")))).alias("near"),
                    merkle.likeness(*map(merkle.clauses, (F.col("own"), F.col("other")))).alias("far")).collect()
    assert all(r.near > r.far for r in got), got
    assert all(r.near > 0.5 for r in got[2:6] + got[:1]) and all(r.near > 0.9 for r in got[-2:]), got
    bags = [([1, 1, 1, 2], [1, 1, 3]), ([], []), ([5], []), ([0, 0, 7], [0, 7, 7])]
    near = spark.createDataFrame(bags, "a array<int>, b array<int>").select(merkle.likeness(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r.near for r in near] == pytest.approx([4 / 7, 1, 0, 4 / 6])


def test_plans_are_native(spark, tmp_path):
    sf = store(spark, tmp_path, documents=frame(spark))
    for df in (merkle.fingerprint(frame(spark)), merkle.op2(spark, sf), pii.op8(spark, sf)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def pages(spark, data=None):
    html = ["<p>a</p>", "", None, "<p>é😀</p>" * 400, "<p>a</p>", "x" * 50_000]
    data = [(i, f"http://h/{i}?q=ü\r\nx", html[i % 6], 1) for i in range(40)] + [(99, None, "<p>a</p>", 1)] if data is None else data
    return spark.createDataFrame(data, "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("least", [0, 100])
def test_archives_hold_every_page(spark, tmp_path, least):
    table = pages(spark)
    files = warc.write(table, str(tmp_path / "w"), least=least, file_bytes=2000)
    data = table.collect()
    first = {}
    for r in data:
        body = (r.html or "").encode()
        if len(body) >= least:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    for range_bytes in (150, 4096, 1 << 20):
        got = {int(r.page_id): r for r in warc.read(spark, files, range_bytes).collect()}
        assert len(got) == len(data) and len({(r.file, r.offset) for r in got.values()}) == len(data)
        for r in data:
            body, x = (r.html or "").encode(), got[r.page_id]
            other = first.get(body, r.page_id)
            assert x.payload_bytes == len(body) and x.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert x.record_type == ("response" if other == r.page_id else "revisit") and x.url == (r.url or "")
            assert x.refers_to == (None if other == r.page_id else str(other)) and x.payload == (body if other == r.page_id else None)


def test_archives_of_odd_tables(spark, tmp_path):
    assert warc.read(spark, warc.write(pages(spark, []), str(tmp_path / "a"))).count() == 0
    odd = pages(spark, [(None, "u", "same", 1), (None, "u", "same", 1), (3, "u", "other", 1), (3, "u", "other", 1)])
    got = Counter((r.page_id, r.record_type) for r in warc.read(spark, warc.write(odd, str(tmp_path / "b"))).collect())
    assert got == {(None, "response"): 2, ("3", "response"): 2}


def test_reader_passes_over_false_magic(tmp_path):
    body = warc.MAGIC * 50
    raw = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = raw.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 150\r\n\r\n" + body + b"\r\n\r\n") + raw.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"junk" + stored + b"junk" + stored)
    size = path.stat().st_size
    for step in (7, 64, 1000):
        with pa.OSFile(str(path)) as source:
            found = [at for s in range(0, size, step) for at, _ in warc.members(source, s, min(s + step, size), size)]
        assert found == [4, 8 + len(stored)]


def test_shards_match_the_mixture(spark):
    out = sharding.assign(frame(spark), shards=5).collect()
    data = rows()
    assert len(out) == len(data)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    counts = [len(v) for v in shards.values()]
    assert set(shards) == set(range(5)) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    for source in {r[3] for r in data}:
        n = [sum(r.source == source for r in v) for v in shards.values()]
        assert max(n) - min(n) <= 2
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert sharding.assign(frame(spark, [])).count() == 0


def test_shards_do_not_depend_on_buckets(spark, monkeypatch):
    docs = frame(spark, [r for r in {r[0]: r for r in rows()}.values()])
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs).collect()}
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.assign(docs).collect()} == one


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id of each component of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, a, least.get(find(i))) for i, (doc, a) in enumerate(prints)]


def test_simhash_equals_plain(spark, tmp_path):
    sf = store(spark, tmp_path, documents=frame(spark))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op10(spark, sf).collect())
    want = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows()])
    assert got == Counter((d, f"{a:016x}", c) for d, a, c in want)


def near_prints(seed, n, centres, flips):
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        base = rnd.getrandbits(64)
        for _ in range(n):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("g", [6, 7, 9])
def test_every_link_is_found(spark, g):
    prints = near_prints(g, 25, 12, 4)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), g)).collect()}
    want = plain_components([(s[0], p) for s, p in zip(signed, prints)])
    assert all(roots.get(d, d) == c for d, _, c in want)


@pytest.mark.parametrize("cell,pairwise", [(8, 4), (40, 10), (10_000, 4)])
def test_large_cells_are_cut_into_blocks(monkeypatch, cell, pairwise):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fps = np.array(near_prints(3, 60, 3, 3), np.uint64)
    keys = np.sort(np.array([i * i // 900 for i in range(len(fps))]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 7]), pa.array(fps[i:i + 7].view(np.int64))], names=["key", "fp"]) for i in range(0, len(fps), 7)]
    links, blocks = set(), defaultdict(set)
    for b in simhash._link(iter(batches)):
        for r in b.to_pylist():
            if r["b"] is None:
                blocks[r["key"]].add((r["block"], r["a"]))
            else:
                links.add((r["a"], r["b"]))
    for key, members in blocks.items():
        assert len(members) > cell and max(Counter(b for b, _ in members).values()) <= cell
        last = max(b for b, _ in members)
        for i in range(last + 1):
            for j in range(i, last + 1):
                own = np.unique(np.array([a for b, a in members if b in (i, j)], np.int64))
                batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), pa.array(own)], names=["key", "fp"])
                links |= {(r["a"], r["b"]) for x in simhash._meet(iter([batch])) for r in x.to_pylist()}
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 64
        parent[find(a)] = find(b)
    signed = fps.view(np.int64).tolist()
    for i in range(len(fps)):
        for j in range(i):
            if keys[i] == keys[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 4:
                assert find(signed[i]) == find(signed[j])


def test_near_equals_hamming():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 64, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(6):
        b ^= (np.uint64(1) << rnd.integers(0, 64, 5000, dtype=np.uint64)) * (rnd.random(5000) < 0.7).astype(np.uint64)
    assert (simhash.near(a, b) == (np.bitwise_count(a ^ b) <= 4)).all()


def test_one_of_each_group_stays(spark):
    docs = frame(spark).withColumn("_kept", F.lit(1))
    out = simhash.first_of_group(docs)
    want = plain_components([(i, plain_fingerprint(t)) for i, t, *_ in rows()])
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({c for _, _, c in want})
    assert simhash.first_of_group(docs.limit(0)).count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rnd = random.Random(8)
    item = prose(rnd, 30)
    data = [r for r in rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    data += [(500 + i, prose(rnd, 30) + " idiots", "en", "s0", 0) for i in range(60)] + [(600, "clean start " + item, "en", "s0", 0)]
    data += [(601 + i, prose(rnd, 20) + f' token = "04dbebab91ab85687d33eeaaf9ac699e1188f96{i}"', "en", "s1", 0) for i in range(3)]
    labels = [(r[0], 1, int("idiots" in (r[1] or ""))) for r in data]
    sf = store(spark, tmp_path, documents=frame(spark, data), labels=spark.createDataFrame(labels, LABELS),
               benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    model = toxicity.fit(frame(spark, data), spark.createDataFrame(labels, LABELS))
    rejected = {r.doc_id for r in toxicity.score(frame(spark, data), model).collect() if r.score >= 0.3}
    kept = [(i, t) for i, t, *_ in data if i not in rejected]
    first = {c for _, _, c in plain_components([(i, plain_fingerprint(t)) for i, t in kept])}
    phrases = decontaminate.Phrases([("1", item)])
    kept = [(i, t) for i, t in kept if i in first]
    kept = [(i, t) for i, t in kept for n, hit, *_ in decontaminate.judge([(t or "").encode()], phrases) if not (hit and 20 * hit >= n)]
    assert set(got) == {i for i, _ in kept} and 600 not in got and not any(500 <= i < 560 for i in got)
    for i, t in kept:
        final = secret_scan.masked(t or "")
        assert got[i].decoded_sha256 == hashlib.sha256(final.encode()).hexdigest() and len(got[i].ids) == 4 * got[i].n_tokens
    assert any("04dbebab" in (t or "") for _, t in kept)


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = store(spark, tmp_path, documents=frame(spark, []), labels=spark.createDataFrame([], LABELS),
               benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert bpe.encode(frame(spark, [])).count() == 0


NAMES = ["component_id", "first_row", "_fp", "_row", "score", "_score", "items", "_items", "n_words", "n_hit", "spans", "hit_words", "_text", "_paragraphs",
         "_sections", "_h", "_o", "_d", "_copy", "c0", "c1", "a.b", "found_", "candidates", "_all", "_company", "_email", "key", "fp", "doc", "text2"]


def with_names(spark, data):
    return frame(spark, data).select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def names_kept(df, columns):
    assert df.columns == columns
    out = [r.asDict() for r in df.collect()]
    for r in out:
        for n in NAMES:
            assert r[n] == f"{n}:{'-' if r['doc_id'] is None else r['doc_id']}", n
    return out


def test_filters_keep_columns_of_any_name(spark):
    data = rows(n=30)
    docs = with_names(spark, data)
    benchmark = spark.createDataFrame([("a", data[0][1])], "item_id string, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(30)], LABELS)
    plain = frame(spark, data)
    assert len(names_kept(simhash.first_of_group(docs), docs.columns)) == simhash.first_of_group(plain).count()
    assert len(names_kept(decontaminate.without(docs, benchmark), docs.columns)) == decontaminate.without(plain, benchmark).count()
    assert len(names_kept(toxicity.clean(docs, labels), docs.columns)) == toxicity.clean(plain, labels).count()
    found = names_kept(pii.find(docs), [*docs.columns, "found"])
    assert len(found) == len(data)


def test_grids_stay_few(spark):
    assert [len(list(combinations(range(simhash.groups_for(10 ** e)), 4))) for e in (4, 6, 8, 10)] == [15, 15, 35, 126]
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(4)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in base + near})
    want = {(a, b) for a in fps for b in fps if a > b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    for g in (6, 9):
        roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), g)).collect()}
        of = lambda f: roots.get(f, f)
        assert all(of(a) == of(b) for a, b in want)
        linked = {f for pair in want for f in pair}
        assert set(roots) <= linked
