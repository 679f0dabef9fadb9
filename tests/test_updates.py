"""Tables kept up to date batch by batch, state machines over event time, weak sheet matching, nested trees, sketches."""

import datetime as dt
import json
import random
import re
import tempfile

from pyspark.sql import functions as F

from marginalia.operators import acl, evaluation, live_index, retrieval, routing, sheets
from marginalia.sources import commits
from marginalia.streaming import ingest as I, lifecycle as L, monitor as M


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stream(spark, schema, batches):
    """One file a batch, in order."""
    src = folder()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def run(frame, mode="append"):
    out = folder() + "/t"
    M.to_table(frame, out, folder(), mode).awaitTermination()
    return out


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_index_after_batches_equals_a_new_one(spark):
    rnd = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta".split()
    text = lambda: " ".join(rnd.choices(words, k=rnd.randint(0, 8)))
    root, now = folder() + "/t", {}
    for batch in range(4):
        files = {f"f{i}": [text() for _ in range(rnd.randint(0, 3))] for i in rnd.sample(range(8), 5)}
        now |= files
        chunks = spark.createDataFrame([(f, n, x) for f, xs in files.items() for n, x in enumerate(xs)], "file_md5 string, chunk_id int, text_content string")
        names = spark.createDataFrame([(f,) for f in files], "file_md5 string")
        for _ in range(2 if batch in (1, 3) else 1):  # replayed batches change nothing
            live_index.update(chunks, names, root, batch)
        whole = spark.createDataFrame([(f, n, x) for f, xs in now.items() for n, x in enumerate(xs)], "file_md5 string, chunk_id int, text_content string")
        anew = retrieval.index_columns(whole)
        assert sorted(map(tuple, live_index.vocabulary(spark, root).collect())) == sorted(map(tuple, retrieval.vocabulary(whole).collect()))
        n, avg = anew.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        assert tuple(live_index.corpus_size(spark, root).first()) == (n, avg)
    assert sorted((r.file_md5, r.chunk_id, r.dl) for r in live_index.rows(spark, root).collect()) == sorted((r.file_md5, r.chunk_id, r.dl) for r in anew.collect())


def test_broken_batches_are_invisible(spark):
    root = folder() + "/t"
    rows = lambda xs: spark.createDataFrame(xs, "file_md5 string, v int")
    files = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file_md5 string")
    assert commits.current(spark, root, "a") is None
    commits.write_batch({"a": rows([("x", 1)])}, files("x"), root, 0)
    assert commits.current(spark, root, "a") is None
    commits.commit({"a": rows([("x", 1), ("y", 1)]), "b": rows([("x", 10)])}, files("x", "y"), root, 0)
    commits.write_batch({"a": rows([("x", 2)])}, files("x"), root, 1)
    see = lambda n: sorted((r.file_md5, r.v) for r in commits.current(spark, root, n).collect())
    assert (see("a"), see("b")) == ([("x", 1), ("y", 1)], [("x", 10)])
    commits.commit({"a": rows([("x", 3)]), "b": rows([])}, files("x"), root, 1)
    assert (see("a"), see("b")) == ([("x", 3), ("y", 1)], [])


CHANGES = "file_md5 string, event_id bigint, status int, ts timestamp_ntz"


def test_status_changes_are_judged_in_the_order_of_time(spark):
    live = stream(spark, CHANGES, [
        [("a", 2, 1, at(20)), ("a", 1, 0, at(10)), ("b", 3, 0, at(12))],
        [("a", 5, 3, at(70)), ("a", 4, 2, at(65)), ("b", 6, 3, at(66)), ("a", 9, 0, at(200))],
        [("b", 7, 1, at(210)), ("z", 8, 0, at(900))],
    ])
    got = {(r.event_id, r.before, r.after, r.legal) for r in spark.read.parquet(run(L.status_steps(live))).collect()}
    assert got == {(1, -1, 0, True), (2, 0, 1, True), (4, 1, 2, True), (5, 2, 3, True), (9, 3, 0, False), (3, -1, 0, True), (6, 0, 3, False), (7, 0, 1, True)}


def test_silent_files_are_forgotten(spark):
    day = 24 * 60
    live = stream(spark, CHANGES, [[("a", 1, 3, at(0)), ("z", 2, 0, at(3 * day))], [("z", 3, 1, at(9 * day))], [("a", 4, 1, at(9 * day + 10)), ("z", 5, 1, at(20 * day))]])
    got = {(r.event_id, r.before, r.legal) for r in spark.read.parquet(run(L.status_steps(live, ttl_days=5))).collect()}
    assert {(1, -1, True), (4, -1, True)} <= got  # with its status remembered, 3 to 1 would be illegal


MESSAGES = "conversation_id bigint, seq bigint, role string, content string, ts timestamp_ntz"


def test_conversation_is_archived_once(spark):
    live = stream(spark, MESSAGES, [
        [(1, 0, "user", "a", at(0)), (1, 1, "assistant", "b", at(5)), (2, 0, "user", "x", at(50))],
        [(1, 2, "user", "c", at(20)), (2, 1, "user", "y", at(70)), (3, 0, "user", "z", at(200))],
        [(1, 2, "user", "c", at(190)), (1, 3, "user", "late", at(195)), (3, 1, "user", "w", at(600))],
    ])
    got = spark.read.parquet(run(L.archived_sessions(live))).collect()
    assert sorted((r.conversation_id, r.seq, r.content) for r in got) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y"), (3, 0, "z")]


def test_done_files_are_skipped_until_they_expire(spark):
    day = 24 * 60
    schema = "user_id bigint, file_md5 string, event_id bigint, ts timestamp_ntz"
    live = stream(spark, schema, [[(1, "a", 1, at(0)), (2, "a", 2, at(1))], [(1, "a", 3, at(day)), (1, "b", 4, at(day))], [(1, "a", 5, at(8 * day)), (1, "b", 6, at(7 * day))]])
    done, out, chk = folder() + "/d", folder() + "/o", folder()
    live.writeStream.foreachBatch(L.skip_done(done, out)).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 4, 5]


def test_dead_letters_keep_reason_and_position(spark):
    schema = "file_md5 string, file_name string, storage_path string, user_id bigint, topic string, partition int, offset bigint"
    rows = spark.createDataFrame([("a", "n", "p", 1, "t", 0, 7), ("b", None, "p", None, "t", 1, 8)], schema)
    root = folder() + "/t"
    for _ in range(2):
        L.two_sinks(root)(I.validated(rows), 0)
    assert [r.file_md5 for r in commits.all_rows(spark, root, "requests").collect()] == ["a"]
    bad = commits.all_rows(spark, root, "dead").collect()
    assert [(r.topic, r.partition, r.offset, r.reason) for r in bad] == [("t", 1, 8, "missing: file_name,user_id")]
    assert json.loads(bad[0].message)["file_md5"] == "b"


def plain_weak(page, tokens, score, lead):
    key = lambda x: re.sub("[ _-]", "", x.lower())
    found = [(sum(t in key(page) for t in toks), -no, s) for no, (s, toks) in enumerate(tokens.items())]
    found = sorted((f for f in found if f[0]), reverse=True)
    if not found:
        return None
    second = found[1][0] if len(found) > 1 else -1
    return (found[0][2], found[0][0], second) if found[0][0] >= max(1, score) and found[0][0] >= second + lead else None


def test_weak_match_beside_plain(spark):
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "common", "al"]
    for score, lead in ((3, 1), (1, 0), (6, 3)):
        files = {f: {f"s{i}": {"common", *rnd.sample(words, rnd.randint(1, 6))} for i in range(n)} for f, n in (("a", 1), ("b", 2), ("c", 5))}
        pages = [(f, p, " ".join(rnd.choices([*words, "nothing"], k=rnd.randint(0, 6)))) for f in files for p in range(12)]
        sh = spark.createDataFrame([(f, s, i) for f, t in files.items() for i, s in enumerate(t)], "file_md5 string, sheet string, sheet_no int")
        tk = spark.createDataFrame([(f, s, x) for f, t in files.items() for s, xs in t.items() for x in xs], "file_md5 string, sheet string, token string")
        got = sheets.match_pages_weak(spark.createDataFrame(pages, "file_md5 string, page int, text string"), sh, tk, score, lead)
        want = {(f, p, *m) for f, p, text in pages if (m := plain_weak(text, files[f], score, lead))}
        assert {tuple(r) for r in got.collect()} == want


def test_nested_tree_of_any_depth(spark):
    tags = [("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("o", "missing"), ("q", None), ('"', "q")]
    df = spark.createDataFrame(tags, "tag_id string, parent_tag string")
    node = lambda i: {"tagId": i, "children": [node(c) for c in sorted(t for t, p in tags if p == i)]}
    assert {r.tag_id: json.loads(r.tree) for r in acl.nested_tree(df).collect()} == {"r": node("r"), "q": node("q")}
    assert sorted(r.tag_id for r in acl.unrooted_tags(df).collect()) == ["o", "x", "y"]
    assert acl.nested_tree(df.limit(0)).count() == 0


def test_sketches_of_days_keep_the_rank(spark):
    e = spark.range(60_000).select((F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 10) * 86_400)).cast("timestamp_ntz").alias("created_at"),
                                   (F.abs(F.hash("id")) % 5_000).alias("latency_ms"), F.lit("a").alias("intent"), F.col("id").alias("event_id"))
    daily = evaluation.daily_sketches(e)
    assert daily.count() == 10
    for r in evaluation.rolled_up(daily, 7).filter("n > 40000").collect():
        day = F.to_date("created_at")
        own = e.filter((day >= F.lit(r.window_start)) & (day < F.date_add(F.lit(r.window_start), 7)))
        assert abs(own.filter(F.col("latency_ms") <= r.percentile).count() / own.count() - 0.95) < 0.0334
    assert [x.n for x in evaluation.top_intents_of(evaluation.daily_intents(e), 10).orderBy(F.col("n").desc()).collect()][0] == 60_000


def test_routes_fall_back_and_add_chunks_of_the_file(spark):
    """Each channel sees only its questions; a strict question without hits falls back, one with few hits of one file gets more."""
    from marginalia import constants as C
    from marginalia.operators import evidence as E, retrieval as R

    q = spark.createDataFrame([(1, "layout of given fields", "general", False, "layout_query"), (2, "flow upstream of parts", "general", True, "flow_query"),
                               (3, "plain words", "general", True, "fact_lookup"), (4, "plain words", "policy", True, "fact_lookup"),
                               (5, "diagram of parts", "general", False, "fact_lookup")],
                              "query_id long, query string, profile string, strict boolean, intent string")
    seen = {}
    hit = "query_id long, rank int, file_md5 string, chunk_id string, text_content string, source_type string, image_path string"

    def channel(name, rows):
        def ask(asked):
            seen[name] = sorted(r.query_id for r in asked.collect())
            return spark.createDataFrame([r for r in rows if r[0] in seen[name]], hit)
        return ask

    hybrid = channel("hybrid", [(1, 1, "f", "0", "layout text", None, None), (3, 1, "f", "2", "plain words", None, None)])
    relation = channel("relation", [(2, 1, "g", "e1", "[关系] a --依赖--> b", None, None)])
    visual = channel("visual", [(1, 1, "f", "-4", "[visual_page] x", "visual", None)])
    asked_again = []

    def keyword(asked, k):
        rows = asked.collect()
        asked_again.append((k, sorted(r.query_id for r in rows), sorted({r.query for r in rows})))
        return spark.createDataFrame([(r.query_id, 1, "f", 1, "plain words again", "doc", 3.0) for r in rows],
                                     "query_id long, rank int, file_md5 string, chunk_id int, text_content string, file_name string, score double")

    names = spark.createDataFrame([("f", "doc"), ("g", "graph")], "file_md5 string, file_name string")
    sources = spark.createDataFrame([("f", 0, "img")], "file_md5 string, chunk_id int, image_path string")
    chunks = spark.createDataFrame([("f", i, "doc", f"chunk {i}") for i in range(12)], "file_md5 string, chunk_id int, file_name string, text_content string")
    profiles = spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS)
    plan = E.retrieval_plan(q, profiles.select(F.col("profile_id").alias("profile"), "enable_relation_index"))
    hits = routing.retrieve(q, plan, {"hybrid": hybrid, "relation": relation, "visual": visual}, keyword, names, sources, chunks, R.channel_weights(profiles))
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    got = {i: [c for _, c in sorted(rows)] for i, rows in got.items()}
    assert seen == {"hybrid": [1, 2, 3, 4, 5], "relation": [2, 3, 5], "visual": [1, 5]}
    assert asked_again[0][:2] == (12, [5]) and "[diagram_page]" in asked_again[0][2][0] and asked_again[1][:2] == (8, [4])
    assert set(got[1]) == {"0", "-4"} and got[2] == ["e1"] and got[5] == ["1"]
    assert got[3] == ["2", "0", "1", "3", "4", "5", "6", "7"] and got[4] == ["1", "0", "2", "3", "4", "5", "6", "7"]
    assert {r.query_id for r in routing.answer_context(q, hits).collect()} == {1, 2, 3, 4, 5}
