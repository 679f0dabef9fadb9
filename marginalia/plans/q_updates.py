"""Registered queries: tables kept up to date batch by batch, state machines, mergeable statistics, nested trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import text as X
from marginalia.functions.text import clean_text
from marginalia.operators import acl, evaluation, live_index, sheets
from marginalia.plans.oracle import with_tables
from marginalia.plans.q_streaming import BATCHES, StreamTables, _ST, _changes, _finish, as_stream
from marginalia.plans.tables import Tables
from marginalia.session import scratch, stored
from marginalia.sources import commits
from marginalia.streaming import ingest as I, lifecycle as L, monitor as M


# --- index under ingest ------------------------------------------------------------------
def arrivals(t: Tables):
    """Documents as files that arrive in three batches: two thirds, then the rest and every third again with a changed text, then
    every sixth again without text and every third as it was."""
    d = t.raw("documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("file_md5"), clean_text(F.col("text")).alias("value"))
    d = stored(d, "cleaned")
    i = F.col("doc_id")
    at = lambda rows, n, v: rows.select("doc_id", "file_md5", v.alias("value"), F.lit(n).alias("arrival"))
    v = F.col("value")
    return (
        at(d.filter(i % 3 != 2), 0, v)
        .unionByName(at(d.filter(i % 3 == 2), 1, v)).unionByName(at(d.filter(i % 3 == 0), 1, F.concat(v, F.lit(" again"))))
        .unionByName(at(d.filter(i % 6 == 0), 2, F.lit(""))).unionByName(at(d.filter(i % 3 == 1), 2, v))
    )


def _whole_texts(files):
    """A file's text as its one chunk; none without text."""
    return files.filter(F.length("value") > 0).select("file_md5", F.lit(0).alias("chunk_id"), F.col("value").alias("text_content"))


def index_under_ingest(t: Tables):
    """The vocabulary after three batches with repeated files, the last of which is replayed."""
    rows = arrivals(t)
    root, chk = scratch(t.spark, "live-index"), scratch(t.spark, "live-index-chk")
    live_index.ingest_indexed(as_stream(t, "arrivals", rows, F.col("arrival")).select("file_md5", "value"), root, chk, _whole_texts).awaitTermination()
    last = rows.filter(F.col("arrival") == BATCHES - 1).select("file_md5", "value")
    live_index.update(_whole_texts(last), last, root, BATCHES - 1)
    size = live_index.corpus_size(t.spark, root)
    return live_index.vocabulary(t.spark, root).withColumns({
        "n_docs": size.select("n_docs").scalar(), "avg_dl": F.round(size.select("avg_dl").scalar(), 6)})


_W = r"[\p{L}\p{N}_]+"
LIVE = {
    "fin": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ct || ' again' ELSE ct END AS x FROM cleaned WHERE doc_id % 6 <> 0 AND length(ct) + (doc_id % 3 = 0)::int > 0",
    "ft2": f"SELECT doc_id, regexp_extract_all(lower(x), '{_W}') AS l FROM fin",
    "fp2": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS term FROM ft2) GROUP BY 1, 2",
}


# --- several tables in one commit ----------------------------------------------------------
def structure_of(blocks) -> dict:
    """Units, blocks, parents and children of line blocks (file_md5, block_index, page, text)."""
    unit = F.concat(F.lit("page:"), F.col("page").cast("string")).alias("unit_key")
    units = blocks.groupBy("file_md5", unit).agg(F.min("block_index").alias("unit_order"))
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    parents = blocks.groupBy("file_md5", unit).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text_content"))
    children = blocks.select("file_md5", F.col("block_index").alias("child_chunk_id"), unit, F.length("text").alias("n_chars"))
    return {"units": units, "blocks": blocks.select("file_md5", "block_index", "text"), "parents": parents, "children": children}


def structure_commits(t: Tables):
    """Lines of all documents committed in three batches; the second is replayed. A fourth batch, which changes every text, breaks
    after two of its tables and is never seen."""
    root, spark = scratch(t.spark, "structure"), t.spark
    lines = t.blocks().filter("text <> ''").select("doc_id", "file_md5", "block_index", "page", "text")
    for n, part in enumerate((F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1, F.col("doc_id") % 5 == 0)):
        own = lines.filter(part)
        own = own.withColumn("text", F.concat("text", F.lit("."))) if n == 2 else own
        for _ in range(2 if n == 1 else 1):
            commits.commit(structure_of(own.drop("doc_id")), t.raw("documents").filter(part).select(F.md5(F.col("doc_id").cast("string")).alias("file_md5")), root, n)
    broken = structure_of(lines.drop("doc_id").withColumn("text", F.lit("broken")))
    commits.write_batch({k: broken[k] for k in ("units", "blocks")}, lines, root, 3)
    out = None
    for name, value in (("units", F.col("unit_order")), ("blocks", F.length("text")), ("parents", F.length("text_content")), ("children", F.col("n_chars"))):
        one = commits.current(spark, root, name).groupBy("file_md5", F.lit(name).alias("part"), "batch").agg(
            F.count("*").alias("n"), F.sum(value.cast("long")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("batch", F.col("batch").cast("int"))


STRUCTURE = {
    "sl": """SELECT file_md5, doc_id, block_index, page, CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS text, (CASE WHEN doc_id % 5 = 0 THEN 2 ELSE doc_id % 2 END)::int AS batch FROM (
      SELECT md5(doc_id::varchar) AS file_md5, doc_id, i AS block_index, i // 20 + 1 AS page, l[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(len(l))) AS i)) WHERE text <> ''""",
    "su": "SELECT file_md5, batch, page, min(block_index) AS o, sum(length(text)) + count(*) - 1 AS n FROM sl GROUP BY ALL",
}


# --- status machine, archive, sessions, dead letters, done files --------------------------------
def status_machine(t: Tables):
    steps = L.status_steps(_changes(StreamTables(t, "events")))
    return _finish(t, steps, "status-steps", ["file_md5", "event_id"], "append")


STATUS_SQL = f"""WITH RECURSIVE e AS (SELECT md5((event_id % 700)::varchar) AS file_md5, event_id, {_ST} AS s, row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) AS i
  FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)),
w AS (SELECT file_md5, i, event_id, -1 AS before, s AS after, true AS legal, s AS now FROM e WHERE i = 1
  UNION ALL SELECT e.file_md5, e.i, e.event_id, w.now, e.s, ok, CASE WHEN ok THEN e.s ELSE w.now END
  FROM (SELECT w.*, e.file_md5 AS f, e.i AS j, e.event_id AS ev, e.s AS es, w.now = e.s OR (w.now, e.s) IN ((0, 1), (1, 2), (2, 3), (2, 4), (4, 2), (3, 2)) AS ok
    FROM w JOIN e ON e.file_md5 = w.file_md5 AND e.i = w.i + 1) w JOIN e ON e.file_md5 = w.f AND e.i = w.j)
SELECT file_md5, event_id, before::int AS before, after::int AS after, legal FROM w"""


def archived_conversations(t: Tables):
    """Conversations as a stream in the order of time; each is archived when it has been idle for half an hour."""
    m = t.messages()
    cuts = m.select(F.percentile_approx("conversation_id", [1 / 3, 2 / 3]).alias("b")).first()[0] or []
    part = sum(((F.col("conversation_id") > b).cast("int") for b in cuts), F.lit(0))
    live = as_stream(t, "messages", m.select("conversation_id", "seq", "role", "content", "ts"), part)
    out = _finish(t, L.archived_sessions(live), "archive", ["conversation_id"], "append")
    return out.select("conversation_id", "seq", "role", F.md5("content").alias("content_md5"))


def stream_sessions(t: Tables):
    """Sessions as a stream in append mode: those that have ended before the watermark."""
    s = M.idle_sessions(StreamTables(t, "events").raw("events"))
    return _finish(t, s, "sessions", ["user_id", "opened_at"], "append").select("user_id", "opened_at", "events")


def dead_letter_sinks(t: Tables):
    """Requests as messages of a topic, split into good rows and dead letters; the second batch is written twice."""
    req = StreamTables(t, "events").parse_requests().withColumns({"topic": F.lit("parse"), "partition": F.lit(0), "offset": F.col("event_id")})
    root, chk = scratch(t.spark, "letters"), scratch(t.spark, "letters-chk")
    write = L.two_sinks(root)

    def twice(batch, batch_id):
        for _ in range(2 if batch_id == 1 else 1):
            write(batch, batch_id)

    I.validated(req).writeStream.foreachBatch(twice).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    good = commits.all_rows(t.spark, root, "requests").select("event_id", F.lit("requests").alias("sink"), F.lit("").alias("reason"))
    dead = commits.all_rows(t.spark, root, "dead").select(F.col("offset").alias("event_id"), F.lit("dead").alias("sink"), "reason")
    return good.unionByName(dead)


DONE_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def done_files(t: Tables):
    """Requests in three batches by time; a file that was let in is done and skipped for seven days."""
    rows = t.parse_requests().select("user_id", "file_md5", "event_id", "ts")
    part = sum(((F.col("ts") >= F.expr(f"timestamp_ntz'{c}'")).cast("int") for c in DONE_CUTS), F.lit(0))
    out, done, chk = (scratch(t.spark, n) for n in ("let-in", "done", "done-chk"))
    q = as_stream(t, "requests", rows, part).writeStream.foreachBatch(L.skip_done(done, out))
    q.option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("file_md5", "user_id", "event_id")


_FIRST = "SELECT file_md5, arg_min(user_id, {'t': ts, 'e': event_id}) AS user_id, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id, min(ts) AS ts FROM"
DONE = {
    "rq3": f"SELECT *, (ts >= TIMESTAMP '{DONE_CUTS[0]}')::int + (ts >= TIMESTAMP '{DONE_CUTS[1]}')::int AS part FROM parse_requests",
    "b0": f"{_FIRST} rq3 WHERE part = 0 GROUP BY 1",
    "b1": f"{_FIRST} (SELECT r.* FROM rq3 r LEFT JOIN b0 ON b0.file_md5 = r.file_md5 WHERE part = 1 AND (b0.ts IS NULL OR b0.ts <= r.ts - INTERVAL 7 DAY)) GROUP BY 1",
    "m1": "SELECT file_md5, max(ts) AS ts FROM (SELECT file_md5, ts FROM b0 UNION ALL SELECT file_md5, ts FROM b1) GROUP BY 1",
    "b2": f"{_FIRST} (SELECT r.* FROM rq3 r LEFT JOIN m1 ON m1.file_md5 = r.file_md5 WHERE part = 2 AND (m1.ts IS NULL OR m1.ts <= r.ts - INTERVAL 7 DAY)) GROUP BY 1",
}


# --- sheets, trees, sketches -------------------------------------------------------------------
def weak_match(t: Tables):
    """Orders as pages that mention parts; part names as sheets, with the words of the name, the brand and the type as tokens."""
    k = F.col("p_partkey")
    own = t.raw("part").select((k % 50).cast("string").alias("file_md5"), F.col("p_name").alias("sheet"), "p_brand", "p_type")
    s = own.select("file_md5", "sheet").distinct().withColumn("sheet_no", F.ascii("sheet") * 1000 + F.length("sheet"))
    words = F.array_distinct(F.concat(F.array("sheet", "p_brand", "p_type"), F.split("sheet", " ")))
    toks = own.select("file_md5", "sheet", F.explode(F.transform(words, X.sheet_match_key)).alias("token"))
    pages = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == k).groupBy((k % 50).cast("string").alias("file_md5"), F.col("l_orderkey").alias("page")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" - ", "p_brand", "p_type", F.reverse("p_name")))), "\n").alias("text"))
    return sheets.match_pages_weak(pages, s, toks).select("file_md5", "page", "sheet", F.col("score").cast("long").alias("score"), F.col("second").cast("long").alias("second"))


_N = "regexp_replace(lower({}), '[ _-]', '', 'g')"
WEAK = {
    "ws": "SELECT DISTINCT (p_partkey % 50)::varchar AS file_md5, p_name AS sheet, ascii(p_name) * 1000 + length(p_name) AS sheet_no FROM part",
    "wt": f"SELECT DISTINCT file_md5, sheet, token FROM (SELECT (p_partkey % 50)::varchar AS file_md5, p_name AS sheet, {_N.format('x')} AS token FROM part, LATERAL (SELECT unnest([p_name, p_brand, p_type] || string_split(p_name, ' ')) AS x)) WHERE length(token) >= 2",
    "wp": f"""SELECT file_md5, page, {_N.format("array_to_string(list_sort(list(DISTINCT x)), chr(10))")} AS k FROM (SELECT (p_partkey % 50)::varchar AS file_md5, l_orderkey AS page,
      p_brand || ' - ' || p_type || ' - ' || reverse(p_name) AS x FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
    "wc": """SELECT file_md5, page, sheet, any_value(sheet_no) AS sheet_no, count(*) AS score FROM wp JOIN wt USING (file_md5) JOIN ws USING (file_md5, sheet) WHERE contains(k, token) GROUP BY 1, 2, 3""",
    "wr": "SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, -1) AS second FROM wc WINDOW w AS (PARTITION BY file_md5, page ORDER BY score DESC, sheet_no)",
}


def nested(t: Tables):
    return acl.nested_tree(t.org_tags())


def sketch_rollup(t: Tables):
    """Weekly percentiles and intents from daily sketches; the rank error of each percentile is held against all events."""
    e = t.usage_events()
    daily = stored(evaluation.daily_sketches(e), "latency-sketches")
    rolled = evaluation.rolled_up(daily)
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_sub(F.to_date("created_at"), i))).alias("window_start")
    exact = e.filter("latency_ms IS NOT NULL").select(starts, "latency_ms").join(F.broadcast(rolled.select("window_start", "percentile")), "window_start")
    rank = exact.groupBy("window_start").agg(F.avg((F.col("latency_ms") < F.col("percentile")).cast("double")).alias("lo"), F.avg((F.col("latency_ms") <= F.col("percentile")).cast("double")).alias("hi"))
    near = (F.col("lo") <= 0.95 + 0.0334) & (F.col("hi") >= 0.95 - 0.0334)
    return rolled.join(rank, "window_start").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", near.alias("within_bound"))


def intent_rollup(t: Tables):
    daily = stored(evaluation.daily_intents(t.usage_events()), "daily-intents")
    top = evaluation.top_intents_of(daily, 7, 3)
    return top.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "intent", "n", "rank")


_DAYS = "(SELECT unnest(range(0, 7)) AS i)"
QUERIES = {
    "r01_live_index": (index_under_ingest, with_tables("""SELECT term, count(*) AS df, sum(tf)::bigint AS cf, (SELECT count(*) FROM ft2) AS n_docs, (SELECT round(avg(len(l)), 6) FROM ft2) AS avg_dl
      FROM fp2 GROUP BY 1""", LIVE)),
    "c08_structure_commits": (structure_commits, with_tables("""SELECT file_md5, 'units' AS part, batch, count(*) AS n, sum(o)::bigint AS total FROM su GROUP BY 1, 3
      UNION ALL SELECT file_md5, 'blocks', batch, count(*), sum(length(text))::bigint FROM sl GROUP BY 1, 3
      UNION ALL SELECT file_md5, 'parents', batch, count(*), sum(n)::bigint FROM su GROUP BY 1, 3
      UNION ALL SELECT file_md5, 'children', batch, count(*), sum(length(text))::bigint FROM sl GROUP BY 1, 3""", STRUCTURE)),
    "m05_status_steps": (status_machine, STATUS_SQL),
    "m07_stream_archive": (archived_conversations, with_tables("""SELECT conversation_id, seq, role, md5(content) AS content_md5 FROM messages WHERE conversation_id IN (
      SELECT conversation_id FROM messages GROUP BY 1 HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM messages))""")),
    "m09_stream_sessions": (stream_sessions, """SELECT user_id, opened_at, n AS events FROM (SELECT user_id, s, min(ts) AS opened_at, max(ts) AS last, count(*) AS n FROM (
      SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2)
      WHERE epoch_ms(last) + 3600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)"""),
    "m04_dead_letters": (dead_letter_sinks, with_tables("""SELECT event_id, CASE WHEN file_name IS NULL THEN 'dead' ELSE 'requests' END AS sink,
      CASE WHEN file_name IS NULL THEN 'missing: file_name' ELSE '' END AS reason FROM parse_requests""")),
    "m02_done_files": (done_files, with_tables("SELECT file_md5, user_id, event_id FROM b0 UNION ALL SELECT file_md5, user_id, event_id FROM b1 UNION ALL SELECT file_md5, user_id, event_id FROM b2", DONE)),
    "j14_weak_match": (weak_match, with_tables("SELECT file_md5, page, sheet, score, second FROM wr WHERE r = 1 AND score >= 3 AND score >= second + 1", WEAK)),
    "g11_nested_tree": (nested, with_tables("""SELECT r.tag_id, '{"tagId":"' || r.tag_id || '","children":[' || coalesce(string_agg(n.tree, ',' ORDER BY n.tag_id), '') || ']}' AS tree
      FROM (SELECT tag_id FROM org_tags WHERE parent_tag IS NULL) r LEFT JOIN (
        SELECT o.tag_id, o.parent_tag, '{"tagId":"' || o.tag_id || '","children":[' || coalesce(string_agg('{"tagId":"' || s.tag_id || '","children":[]}', ',' ORDER BY s.tag_id), '') || ']}' AS tree
        FROM org_tags o LEFT JOIN org_tags s ON s.parent_tag = o.tag_id WHERE o.tag_id LIKE 'N%' GROUP BY 1, 2) n ON n.parent_tag = r.tag_id GROUP BY r.tag_id""")),
    "a04_sketch_rollup": (sketch_rollup, with_tables(f"""SELECT strftime(created_at::date - i::int, '%Y-%m-%d') AS window_start, count(*) AS n, true AS within_bound FROM usage_events, {_DAYS} GROUP BY 1""")),
    "a06_intent_rollup": (intent_rollup, with_tables(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, intent) AS rank FROM (
      SELECT strftime(created_at::date - i::int, '%Y-%m-%d') AS window_start, coalesce(nullif(trim(intent), ''), 'unknown') AS intent, count(*) AS n FROM usage_events, {_DAYS} GROUP BY 1, 2)) WHERE rank <= 3""")),
}
