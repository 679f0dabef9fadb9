"""Steps whose rows must not grow with pairs: what is shuffled or how it is dealt, and the plain result beside it."""

import math
import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marginalia.operators import acl, evaluation, evidence, graph, live_index, retrieval, scoring, sheets
from marginalia.plans import joins, q_graph, q_sheets, q_streaming
from marginalia.plans.tables import Tables
from marginalia.sources import files
from marginalia.streaming import ingest


def shuffled_rows(spark, make):
    """The rows that a job's stages write to shuffles, and what it returns."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        seen = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum({seen.apply(i).stageId(): seen.apply(i).shuffleWriteRecords() for i in range(seen.size())}.values())

    before = total()
    out = make()
    return total() - before, out


def shuffled_bytes(spark, make):
    """The bytes that a job's stages write to shuffles, and what it returns."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        seen = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum({seen.apply(i).stageId(): seen.apply(i).shuffleWriteBytes() for i in range(seen.size())}.values())

    before = total()
    out = make()
    return total() - before, out


def test_user_tags_are_dealt_by_the_rows_they_make(spark):
    tags = spark.createDataFrame([("R", None)] + [(f"S{i}", "R") for i in range(300)], "tag_id string, parent_tag string")
    users = spark.createDataFrame([(i, "R, S1," if i % 2 else None) for i in range(400)], "user_id long, org_tags string")
    out = acl.user_tags(users, acl.tag_ancestors(tags), 5000)
    rows = [tuple(r) for r in out.collect()]
    want = {(i, "DEFAULT") for i in range(400)} | {(i, t) for i in range(1, 400, 2) for t in ["R"] + [f"S{j}" for j in range(300)]}
    assert len(rows) == len(want) and set(rows) == want
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < len(want) / 3


def test_readable_files_of_one_token_are_dealt_by_the_rows_they_make(spark):
    users = spark.range(400).select(F.col("id").alias("user_id"), F.array(F.lit("public"), F.concat(F.lit("u:"), "id")).alias("tokens"))
    files = spark.range(400).select(F.concat(F.lit("f"), "id").alias("file_md5"), F.array(F.lit("public"), F.concat(F.lit("u:"), F.col("id") % 7), F.lit("any")).alias("file_tokens"))
    out = acl.readable_files(users, files, pairs=10_000)
    assert out.count() == out.distinct().count() == 160_000
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 60_000


def test_pairs_of_large_groups_are_written_in_few_bytes(spark, tmp_path):
    names = spark.range(200).select(F.md5(F.col("id").cast("string")).alias("file_md5"), F.lit("k").alias("kind"))
    users = spark.range(20_000).select(F.lit("k").alias("kind"), F.col("id").alias("user_id"))
    path = str(tmp_path / "pairs")
    joins.many_to_many(names, users, "kind").select("user_id", "file_md5").write.parquet(path)
    out = spark.read.parquet(path)
    assert out.count() == out.distinct().count() == 4_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 4_000_000 / 2


@pytest.mark.parametrize("small", [True, False])
def test_many_to_many_beside_plain(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "is_small", lambda df: small)
    rnd = random.Random(3)
    lefts = [(rnd.choice("aabc") if i % 9 else None, i // 2 if i % 5 else None, f"x{i % 3}") for i in range(400)]
    rights = [(rnd.choice("aad") if i % 9 else None, i // 3 if i % 5 else None) for i in range(700)]
    left, right = spark.createDataFrame(lefts, "k string, a long, b string"), spark.createDataFrame(rights, "k string, c long")
    got = Counter(map(tuple, joins.many_to_many(left, right, "k", 2000).collect()))
    assert got == Counter((k, a, b, c) for k, a, b in lefts for r, c in rights if k is not None and k == r)
    assert joins.many_to_many(left.limit(0), right, "k").count() == joins.many_to_many(left, right.limit(0), "k").count() == 0


def test_drawing_edges_look_at_every_spot_once(spark):
    nodes = [(no, f"n{no}", 10.0 * (no % 5), 7.0 * (no % 3)) for no in range(300)]
    ends = [(c, float(c % 40), float(c % 7), float((c * 7) % 40), float(c % 11)) for c in range(4000)]
    n = spark.createDataFrame([("f", "s", *r) for r in nodes], "file_md5 string, sheet string, node_no int, name string, x double, y double")
    c = spark.createDataFrame([("f", "s", *r) for r in ends], "file_md5 string, sheet string, conn_no int, x1 double, y1 double, x2 double, y2 double")
    rows, got = shuffled_rows(spark, lambda: sheets.drawing_edges(n, c, 25.0).collect())

    def nearest(x, y):
        d, no, name = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), no, name) for no, name, a, b in nodes)
        return (d, name) if d <= 25 else None

    want = {}
    for _, x1, y1, x2, y2 in ends:
        a, b = nearest(x1, y1), nearest(x2, y2)
        if a and b and a[1] != b[1]:
            want.setdefault((a[1], b[1]), max(0.4, min(0.95, 1 - (a[0] + b[0]) / 80)))
    assert {(r["src"], r["dst"]) for r in got} == set(want)
    assert all(abs(r["confidence"] - want[r["src"], r["dst"]]) <= 0.005001 for r in got)
    assert rows < 30_000  # 8,000 ends in nine cells each were 72,000


def test_schedule_rows_are_cut_before_they_meet_the_questions(spark):
    words = ["ring gear", "ring bolt", "anvil", "widget"]
    data = [(i, words[i % 4], ["general", "design"][i % 2], (i * 37 % 100) / 100) for i in range(1200)]
    rows = spark.createDataFrame([(f"f{i % 5}", i, "s", w, "", "", p, c) for i, w, p, c in data],
                                 "file_md5 string, row_id long, sheet string, task string, detail string, raw_text string, kb_profile string, confidence double")
    files = spark.createDataFrame([(f"f{i}", ["any", f"u:{i}", "public"] if i else ["any", "u:0"]) for i in range(5)], "file_md5 string, file_tokens array<string>")
    asked = [(n, ["ring gear", "anvil", "ring", "?"][n % 4], ["general", "design"][n // 4 % 2], ["public"] if n % 3 else ["u:0", "public"]) for n in range(240)]
    q = spark.createDataFrame(asked, "query_id long, query string, profile string, tokens array<string>")
    n_rows, got = shuffled_rows(spark, lambda: evidence.schedule_matches(rows, q, files, 3).collect())
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["score"]))
    for n, text, profile, tokens in asked:
        kw = [] if text == "?" else text.split()
        best = []
        for i, w, p, c in data:
            hit = sum(k in w for k in kw)
            if (hit or not kw) and (i % 5 or "u:0" in tokens):
                best.append((-round(hit + (p == profile) + c, 6), i))
        want = [(r, i, -s) for r, (s, i) in enumerate(sorted(best)[:3], 1)]
        assert sorted(found[n]) == want, n
    assert n_rows < 40_000  # 240 questions met some hundred rows each, through every token


def test_evidence_is_cut_before_it_meets_the_questions(spark):
    data = [(f"f{i % 3}", f"e{i:04d}", f"a{i % 300}", f"b{i % 200}", "depends", i % 7) for i in range(1500)]
    edges = spark.createDataFrame([(*r, "graph") for r in data], "file_md5 string, edge_id string, src string, dst string, relation_type string, page int, file_name string")
    files = spark.createDataFrame([("f0", ["u:0", "any"]), ("f1", ["public", "any"]), ("f2", ["public", "any"])], "file_md5 string, file_tokens array<string>")
    asked = [(n, ["depends flow a12", "flow a12 b20", "flow graph"][n % 3], ["public"] if n % 2 else ["u:0", "public"]) for n in range(60)]
    q = spark.createDataFrame(asked, "query_id long, query string, tokens array<string>")
    n_rows, got = shuffled_rows(spark, lambda: graph.evidence_search(q, edges, files, 4).collect())
    terms = {r["query_id"]: r["t"] for r in q.select("query_id", graph.Q.relation_terms(F.col("query")).alias("t")).collect()}
    related = {r["query_id"] for r in q.filter(graph.Q.is_relation_query(F.col("query"))).collect()}
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["edge_id"], r["score"]))
    assert related and set(found) <= related
    for n, _, tokens in asked:
        one = {}
        for f, e, a, b, kind, page in data:
            m = sum(t in f"{a} {kind} {b} graph" for t in terms[n])
            if n in related and m and (f != "f0" or "u:0" in tokens):
                one[f, a, b] = max(one.get((f, a, b), (-1, "", "", 0)), (page, e, f, m))
        best = sorted(one.values(), reverse=True)[:4]
        assert sorted(found.get(n, [])) == [(r, e, round(1 + 0.04 * m, 4)) for r, (_, e, _, m) in enumerate(best, 1)], n
    assert n_rows < 25_000


def test_compared_anchors_read_the_hits_once(spark):
    hits = spark.range(3000).select(
        (F.col("id") % 3).alias("query_id"), F.col("id").alias("rank"),
        F.when(F.col("id") % 5 < 2, "an anvil here").when(F.col("id") % 5 == 2, "widget-gear").otherwise("nothing").alias("text_content"))
    q = spark.createDataFrame([(i, "compare anvil widget", "general") for i in range(3)], "query_id long, query string, profile string")
    calls = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            calls.add(len(pdf))
            yield pdf

    seen = hits.mapInPandas(counted, hits.schema)
    got = {(r["query_id"], r["anchor"]): (r["matches"], r["snippets"]) for r in evidence.compare_answer(seen, q).collect()}
    texts = {(i % 3, i): "an anvil here" if i % 5 < 2 else "widget-gear" if i % 5 == 2 else "" for i in range(3000)}
    for query in range(3):
        for word in ("anvil", "widget"):
            want = [t for (n, _), t in texts.items() if n == query and word in t]
            assert got[query, word] == (len(want), want[:3])
    assert calls.value == 3000


def test_received_parts_are_counted_without_a_bitmap_per_file(spark):
    rows = [("a", 0), ("a", 0), ("a", 2), ("a", 40_000), ("b", 5), ("c", None)]
    out = evaluation.upload_bitmaps(spark.createDataFrame(rows, "file_md5 string, chunk_index int"))
    assert sorted((r["file_md5"], r["received"]) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 0)]
    assert "bitmap_construct_agg" not in out._jdf.queryExecution().toString()


def test_terms_of_a_long_text_are_counted_in_one_pass(spark):
    words = [f"w{i * 7919 % 60_000}" for i in range(60_000)] + ["w1", "w1"]
    chunks = spark.createDataFrame([("f", 0, " ".join(words)), ("g", 0, ""), ("h", 0, None)], "file_md5 string, chunk_id int, text_content string")
    started = time.perf_counter()
    rows = {r["file_md5"]: r for r in retrieval.index_columns(chunks).select("file_md5", "dl", "tf").collect()}
    spent = time.perf_counter() - started
    assert rows["f"]["dl"] == 60_002 and {x["term"]: x["tf"] for x in rows["f"]["tf"]} == dict(Counter(words))
    assert [rows[f]["tf"] for f in "gh"] == [[], []]
    assert spent < 10  # every term was looked up in the whole list: 60,000 times 60,000 comparisons
    plan = retrieval.vocabulary(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a filter before the explode took the texts apart twice more


def test_index_update_takes_texts_apart_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            calls.add(len(pdf))
            yield pdf

    chunks = spark.createDataFrame([(f"f{i}", 0, f"ring w{i}") for i in range(40)], "file_md5 string, chunk_id int, text_content string")
    live_index.update(chunks.mapInPandas(counted, chunks.schema), chunks.select("file_md5"), str(tmp_path / "t"), 0)
    assert calls.value == 40
    live_index.update(chunks.limit(0), chunks.select("file_md5"), str(tmp_path / "t"), 1)
    assert live_index.vocabulary(spark, str(tmp_path / "t")).count() == 0


def test_texts_of_files_that_come_once_are_not_shuffled(spark, tmp_path):
    rnd = random.Random(6)
    data = [(f"f{i}", 1, "".join(rnd.choices("abcdefghij ", k=1500))) for i in range(1000)]
    schema = "file_md5 string, version int, value string"
    again = [("f3", 2, "new"), ("f4", 0, "old"), ("f5", 1, "~"), ("f5", 1, "~"), (None, 1, "x"), (None, 2, "y"), (None, None, "z")]
    for some, most in ((data, 0), (data + again, 60_000)):
        spark.createDataFrame(some, schema).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "t"))
        batch = spark.read.parquet(str(tmp_path / "t"))
        moved, got = shuffled_bytes(spark, lambda: ingest.newest_versions(batch, ["version"]).collect())
        want = {}
        for f, v, x in sorted(some, key=lambda r: (r[1] or -1, r[2])):
            want[f] = (f, v, x)
        assert Counter(map(tuple, got)) == Counter(want.values())
        assert moved < 60_000 + most < sum(len(r[2]) for r in data) / 5
    files = spark.createDataFrame([(f, 0, x) for f, _, x in data], "file_md5 string, chunk_id int, text_content string")
    live_index.update(files, files.select("file_md5"), str(tmp_path / "index"), 0)
    assert sorted(r["df"] for r in live_index.vocabulary(spark, str(tmp_path / "index")).collect()) == sorted(retrieval.vocabulary(files).toPandas()["df"])


def test_candidate_chunks_are_not_shuffled_per_query(spark):
    words = [f"w{i}" for i in range(12)]
    texts = {(f"f{i % 40:02d}", i // 40): " ".join(words[(i * s + s) % 12] for s in range(1, 8 + i % 5)) for i in range(800)}
    chunks = spark.createDataFrame([(f, c, t, ["any", "public"] if f != "f00" else ["any"]) for (f, c), t in texts.items()],
                                   "file_md5 string, chunk_id int, text_content string, file_tokens array<string>")
    asked = {n: " ".join(words[(n + s * (1 + n % 3)) % 12] for s in range(2 + n % 6)) for n in range(200)} | {200: "w1 unknown", 201: "", 202: "w3"}
    q = spark.createDataFrame([(n, t, ["public"] if n % 2 else ["any"]) for n, t in asked.items()], "query_id long, query string, tokens array<string>")
    rows, got = shuffled_rows(spark, lambda: retrieval.text_scores(retrieval.index_columns(chunks), q, prefix=True).collect())
    df = Counter(w for t in texts.values() for w in set(t.split()))
    idf = {w: math.log(1 + (800 - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    avg = sum(len(t.split()) for t in texts.values()) / 800
    want = {}
    for n, text in asked.items():
        terms = list(dict.fromkeys(text.split()))
        form = " " + "  ".join(text.split()) + " "
        for (f, c), t in texts.items():
            own = t.split()
            body, part = " " + "  ".join(own) + " ", lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / avg))
            held = [w for w in terms if w in own]
            if not held or (f == "f00" and n % 2):
                continue
            match = sum(idf[w] * part(own.count(w)) for w in held) if len(held) >= max(1, len(terms) * 6 // 10) else 0.0
            full = sum(idf.get(w, 0.0) for w in terms)
            phrase, prefix = (full * part(k) if k else 0.0 for k in (body.count(form), body.count(form.rstrip()) if len(text) <= 24 else 0))
            if match > 0 or phrase > 0 or prefix > 0:
                want[n, f, c] = (match, phrase, prefix)
    found = {(r["query_id"], r["file_md5"], r["chunk_id"]): (r["match"], r["phrase"], r["prefix"]) for r in got}
    assert len(got) == len(found) and set(found) == set(want) and len(want) > 50_000
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(found[k], want[k]))
    assert rows < 10_000  # every pair was, several times


def test_queries_of_the_same_words_are_scored_once(monkeypatch):
    calls, part = [], scoring.tf_part
    monkeypatch.setattr(scoring, "tf_part", lambda tf, dl, avg: calls.append(1) or part(tf, dl, avg))
    asked = [Row(query_id=j, reader=[f"t{j % 3}"] if j != 7 else None, enough=1, need=1, n_terms=2, idf_sum=3.0, avg_dl=2.0, whole=" a  b ", short=0,
                 entries=[("a", 1.0), ("b", 2.0)]) for j in range(60)]
    n = 30
    index = pa.RecordBatch.from_pydict({"key": list(range(n)), "dl": [2] * n, "terms": [["a", "b"]] * n, "tfs": [[1, 1]] * n,
                                        "file_tokens": [[f"t{i % 3}"] if i else None for i in range(n)], "body": [" a  b "] * n})
    schema = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), *[(c, pa.float64()) for c in ("match", "phrase", "prefix")]])
    got = pa.Table.from_batches(scoring.text_pass(asked, ["key"], schema)(iter([index])), schema).to_pylist()
    want = {(j, i) for j in range(60) for i in range(1, n) if j != 7 and j % 3 == i % 3}
    assert {(r["query_id"], r["key"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["match"] - 3.0) < 1e-9 and abs(r["phrase"] - 3.0) < 1e-9 and r["prefix"] == 0 for r in got)
    assert len(calls) < 2 * n  # one per chunk, not one per pair


def test_hits_of_a_common_word_are_cut_in_their_task(spark):
    data = [("f%d" % (i // 4 % 30), i % 4, (i, i % 4), [f"t{i % 3}", None, "any"] if i % 7 else None, ["common"] + ["rare"] * (i % 500 == 3)) for i in range(3000)]
    schema = "file_md5 string, chunk_id int, row_order struct<doc_id int, chunk_id int>, file_tokens array<string>, terms array<string>"
    rows = spark.createDataFrame(data, schema).repartition(3)
    out = [(r["term"], r["row_order"]["doc_id"]) for r in acl.first_of_task(rows, ["file_md5", "chunk_id"], "row_order", 5).collect()]
    assert len(out) == len(set(out)) <= 3 * 2 * 4 * 5 < sum(len(d[4]) for d in data) / 10
    for term in ("common", "rare"):
        for token in ("t0", "t1", "t2", "any"):
            first = sorted(d[2][0] for d in data if term in d[4] and token in (d[3] or []))[:5]
            assert set(first) <= {doc for t, doc in out if t == term}


def test_fallback_hits_are_not_shuffled_with_all_their_terms(spark):
    chunks = spark.range(4000).select(
        F.concat(F.lit("f"), F.floor(F.col("id") / 2)).alias("file_md5"), (F.col("id") % 2).alias("chunk_id"), F.struct("id").alias("row_order"),
        F.array(F.lit("any"), F.concat(F.lit("t"), F.floor(F.col("id") / 2) % 3)).alias("file_tokens"), F.lit("n").alias("file_name"), F.lit("p").alias("kb_profile"),
        F.concat_ws(" ", *[F.lit(f"word{i}") for i in range(20)], F.col("id")).alias("text_content"))
    queries = spark.createDataFrame([(i, ["any"] if i % 2 else [f"t{i % 3}"], "p", f"word{i} word{(i + 1) % 20}") for i in range(20)], "query_id int, tokens array<string>, profile string, query string")
    quality = spark.createDataFrame([], "file_md5 string, chunk_id long, quality_status string")
    moved, got = shuffled_rows(spark, lambda: retrieval.keyword_fallback(chunks, queries, quality, 3).collect())
    assert moved < 4000 * 20 / 2
    want = {(i, n) for i in range(20) for n in [x for x in range(4000) if i % 2 or x // 2 % 3 == i % 3][:3]}
    assert {(r["query_id"], int(r["text_content"].split()[-1])) for r in got} == want and len(got) == len(want)


def test_relation_index_searches_the_lines_once(spark):
    plan = q_graph.index(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Window" not in plan  # every reader of the edges searched the lines again


def test_paths_many_searches_ask_for_are_walked_once(spark):
    into = [("f", f"s{i:03d}>m{m:02d}", f"s{i:03d}", f"m{m:02d}", "r") for i in range(300) for m in range(20)]
    edges = spark.createDataFrame(into + [("f", f"m{m:02d}>A", f"m{m:02d}", "A", "r") for m in range(20)],
                                  "file_md5 string, edge_id string, src string, dst string, relation_type string")
    edges = edges.unionByName(edges)  # customers of one name
    asked = spark.createDataFrame([(i, "f", n) for i in range(300) for n in (f"s{i:03d}", "A")], "search_id long, file_md5 string, node string")
    want = sorted((i, f"s{i:03d}", ("A", (f"s{i:03d}>m00", "m00>A"))) for i in range(300))
    for make in (lambda: graph.first_paths(asked, edges, 2), lambda: graph.one_way(graph.shortest_paths(asked, edges))):
        rows, got = shuffled_rows(spark, lambda: make().collect())
        assert sorted((r["search_id"], r["high"], (r["low"], tuple(r["path"]))) for r in got) == want
        assert all(r["reverse"] for r in got)
        assert rows < 60_000  # each search walked by itself
    text = graph.path_results(graph.first_paths(asked.filter("search_id = 7"), edges, 2), edges).collect()
    assert [r["text_content"] for r in text] == [f"{graph.C.PATH_MARK} s007 --r--> m00 ; m00 --r--> A"]


def plain_pages(pages, rows, tokens):
    """The sheet of every page by pairing all pages and sheets of a file: (file_md5, page, sheet, n_named)."""
    want = set()
    for f, p, body in pages:
        k = body.replace(" ", "")
        hit = [(sum(t in k for g, m, t in tokens if (g, m) == (f, n)), -i, n) for g, n, i in rows if g == f and n.replace(" ", "") in k]
        if hit:
            want.add((f, p, max(hit)[2], len(hit)))
    return want


def sheet_tables(spark):
    rnd = random.Random(4)
    names = {f: [f"{f}sheet {i}" for i in range(30)] + ["q"] for f in ("a", "b")}
    rows = [(f, n, i) for f in names for i, n in enumerate(names[f])]
    tokens = [(f, n, t) for f, n, i in rows for t in {n.replace(" ", ""), f"tok{i % 4}", "" if i % 3 else "w"}]
    filler = lambda: "".join(chr(0x4E00 + rnd.randrange(8000)) for _ in range(6_000))
    text = lambda f, p: " ".join([*(names[f][(p + j) % 31] for j in range(p % 5)), f"tok{p % 4}", filler()])
    pages = [(f, p, text(f, p)) for f in names for p in range(60)]
    return (pages, rows, tokens), (
        spark.createDataFrame(pages, "file_md5 string, page int, text string"),
        spark.createDataFrame(rows, "file_md5 string, sheet string, sheet_no int"), spark.createDataFrame(tokens, "file_md5 string, sheet string, token string"))


def test_page_texts_are_not_shuffled_to_find_sheet_names(spark):
    plain, tables = sheet_tables(spark)
    size, got = shuffled_bytes(spark, lambda: sheets.match_pages(*tables).collect())
    assert sorted((r["file_md5"], r["page"], r["sheet"], r["n_named"]) for r in got) == sorted(plain_pages(*plain))
    assert size < 500_000  # each of 240 hits had its page text of 18 KB


def test_more_sheet_names_than_an_automaton_holds(spark, monkeypatch):
    plain, tables = sheet_tables(spark)
    monkeypatch.setattr(sheets, "MANY_TERMS", 10)
    got = sheets.match_pages(*tables).collect()
    assert sorted((r["file_md5"], r["page"], r["sheet"], r["n_named"]) for r in got) == sorted(plain_pages(*plain))


def test_sheets_meet_sets_of_tokens_not_pages(spark):
    tokens = [("a", f"s{i}", t) for i in range(40) for t in (f"own{i}", f"kind{i % 2}", f"brand{i % 5}")]
    sh = spark.createDataFrame([("a", f"s{i}", i) for i in range(40)], "file_md5 string, sheet string, sheet_no int")
    tk = spark.createDataFrame(tokens, "file_md5 string, sheet string, token string")
    named = F.when(F.col("id") % 3 == 0, F.concat(F.lit("own"), F.col("id") % 10)).otherwise("z")
    pages = spark.range(3000).select(F.lit("a").alias("file_md5"), F.col("id").alias("page"), F.concat(
        F.lit("kind"), F.col("id") % 2, F.lit(" - brand"), F.col("id") % 5, F.lit(" - "), named).alias("text"))
    n_rows, got = shuffled_rows(spark, lambda: sheets.match_pages_weak(pages, sh, tk).collect())
    assert sorted((r["page"], r["sheet"], r["score"], r["second"]) for r in got) == [(p, f"s{p % 10}", 3, 2) for p in range(0, 3000, 3)]
    assert n_rows < 12_000  # 3,000 pages met some 24 sheets each


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 8  # as many splits as cores, but one of them holds all rows
        parts = joins.spread(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) < 2000


def filters_of(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]


def test_texts_are_not_worked_out_for_a_filter_first(spark):
    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    assert t.chunks().count() > 0 and t.blocks().count() > 0
    for df in (t.chunks(), t.blocks(), q_sheets.analysis_blocks(t), q_streaming.markdown_blocks(t)):
        seen = filters_of(df)
        assert not any(w in x for x in seen for w in ("regexp_replace", "split(", "transform(", "from_json")), seen


def test_empty_texts_give_no_blocks(spark):
    rows = spark.createDataFrame([("a.md", "# \n"), ("b.txt", " x "), ("c.txt", None), ("d.md", "**y**")], "file_name string, value string")
    got = files.text_blocks(rows).collect()
    assert sorted((r["file_name"], r["text"]) for r in got) == [("b.txt", "x"), ("d.md", "y")]
