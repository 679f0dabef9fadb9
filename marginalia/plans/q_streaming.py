"""Registered queries: streaming runs over the given tables, and their batch forms; sources and sinks."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.operators import evaluation
from marginalia.plans.oracle import clean, with_tables
from marginalia.plans.tables import Tables
from marginalia.session import scratch
from marginalia.sources import files as SF, tables as ST, topics
from marginalia.streaming import ingest as I, monitor as M, state as S


BATCHES = 3
ORDER = {"events": "ts", "conversations": "turn"}


def stream_of(t: Tables, name: str):
    return as_stream(t, name, t.raw(name))


def as_stream(t: Tables, name: str, rows, part=None):
    """A table as a stream of several micro-batches, each of several files.

    Tables with a time come in its order, the others by a hash of the row, so keys recur in later batches. ``part`` numbers the
    batches otherwise.
    """
    path = scratch(t.spark, f"{name}-stream")
    if part is not None:
        pass
    elif name in ORDER:
        at = F.col(ORDER[name])
        at = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ORDER[name]})") if name == "events" else at
        bounds = rows.select(F.percentile_approx(at, [i / BATCHES for i in range(1, BATCHES)]).alias("b")).first()[0] or []
        part = sum(((at > b).cast("int") for b in bounds), F.lit(0))
    else:
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(BATCHES)).cast("int")
    files = max(1, rows.rdd.getNumPartitions() // BATCHES)  # every batch has as many, so a trigger takes one batch
    for i in range(BATCHES):  # one after the other: the source takes files by age
        rows.filter(part == i).repartition(files).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


class StreamTables(Tables):
    """The same derivations with one table read as a stream."""

    def __init__(self, t: Tables, name: str):
        super().__init__(t.spark, t.dir)
        self.streamed = name

    def raw(self, name: str):
        return stream_of(Tables(self.spark, self.dir), name) if name == self.streamed else super().raw(name)


def _files_read(query) -> int:
    """Micro-batches of data behind the query; every file of `as_stream` is one."""
    last = query.lastProgress
    end = last["sources"][0]["endOffset"] if last else None
    found = re.search(r"logOffset\D+(\d+)", str(end))
    return int(found[1]) + 1 if found else 0


def _finish(t: Tables, stream, name: str, keys: list[str], mode: str = "update", until=None):
    """Run a stream over all there is, or until its table is complete, and return the table."""
    out, chk = scratch(t.spark, name), scratch(t.spark, f"{name}-chk")
    # keyed state needs this store; a state partition keeps a Python worker, so there are no more than cores
    partitions = min(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": S.ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: t.spark.conf.get(k) for k in own}
    for k, v in own.items():
        t.spark.conf.set(k, v)
    try:
        query = M.to_table(stream, out, chk, mode, endless=until is not None)
        if until is None:
            query.awaitTermination()
        else:
            # with processing-time state there is always another batch: stop when all files are read and the table is complete
            while query.isActive and not (_files_read(query) >= BATCHES and until(out)):
                time.sleep(1)
            if query.exception():
                raise query.exception()
            query.stop()
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v)
    return M.newest(t.spark, out, keys)


def monitor_stream(t: Tables):
    m = _finish(t, M.daily_monitor(StreamTables(t, "events").usage_events()), "monitor", ["window_start"])
    return _rounded(m)


def _rounded(m):
    for c in ("error_rate", "no_evidence_rate", "avg_latency"):
        m = m.withColumn(c, F.round(c, 6))
    return m.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def monitor_weekly(t: Tables):
    return _rounded(M.weekly_monitor(t.usage_events()))


def progress_stream(t: Tables):
    parts = stream_of(t, "lineitem").select(
        F.md5(F.col("l_orderkey").cast("string")).alias("file_md5"), (F.col("l_linenumber") - 1).alias("chunk_index"))
    return _finish(t, M.upload_counts(parts), "uploads", ["file_md5"])


def idempotent_stream(t: Tables):
    """Distinct (user, file) requests through the stream, written once each."""
    out, chk = scratch(t.spark, "requests"), scratch(t.spark, "requests-chk")
    req = I.validated(StreamTables(t, "events").parse_requests()).filter("missing = ''")
    q = I.once_per_file(req).select("user_id", "file_md5").writeStream.foreachBatch(I.append_new(t.spark, out, ["user_id", "file_md5"]))
    q.option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


def idempotent_batch(t: Tables):
    req = I.validated(t.parse_requests()).filter("missing = ''")
    return I.first_requests(req).select("user_id", "file_md5", "event_id")


def validation(t: Tables):
    return I.validated(t.parse_requests()).select("event_id", "missing")


def ingest_stream(t: Tables):
    """Documents as a stream of files into the chunk table."""
    files = stream_of(t, "documents").select(
        F.md5(F.col("doc_id").cast("string")).alias("file_md5"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("file_name"), F.col("text").alias("value"))
    table, chk = scratch(t.spark, "chunks"), scratch(t.spark, "chunks-chk")
    I.ingest(files, table, chk).awaitTermination()
    return I.ingested(t.spark, table).select("file_md5", "chunk_id", F.md5("text_content").alias("text_md5"), "quality_score", "quality_status")


def _changes(t: Tables):
    order = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
    st = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    return t.raw("events").select(F.md5((F.col("event_id") % 700).cast("string")).alias("file_md5"), st[F.col("event_type")].alias("status"), "ts", "event_id")


def status_stream(t: Tables):
    return _finish(t, M.latest_status(_changes(StreamTables(t, "events"))), "status", ["file_md5"]).select("file_md5", "status", "changed_at", "changes")


def sessions(t: Tables):
    return M.idle_sessions(t.raw("events")).select("user_id", "opened_at", "events")


#: Requests of a user, and seconds of a window.
RATE = (3, 21_600)


def _timed(events):
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return events.select("user_id", "event_id", at.alias("at"))


def rates(t: Tables):
    return S.rate_limited_batch(_timed(t.raw("events")), *RATE)


def rate_stream(t: Tables):
    r = S.rate_limited(_timed(stream_of(t, "events")), *RATE)
    return _finish(t, r, "rates", ["user_id", "event_id"], "append")


RATE_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::double AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, sec AS opened, 1 AS n FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, CASE WHEN e.sec >= w.opened + {RATE[1]} THEN e.sec ELSE w.opened END, CASE WHEN e.sec >= w.opened + {RATE[1]} THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT w.user_id, e.event_id, n <= {RATE[0]} AS allowed FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i"""


def _handled(file_md5: str) -> bool:
    """A handler that never succeeds for a quarter of the files."""
    if file_md5[0] in "0123":
        raise RuntimeError("broken file")
    return True


def retries(t: Tables):
    """Requests through the retry state, until every file is done or given up: one row per attempt."""
    files = t.parse_requests().select("file_md5").distinct()
    n = files.count()

    def settled(path: str) -> bool:
        return t.spark.read.parquet(path).filter(F.col("status").isin(C.STATUS_DONE, C.STATUS_FAILED)).count() >= n

    r = _finish(t, S.with_retries(as_stream(t, "requests", files), _handled), "retries", ["file_md5", "attempts"], "append", settled)
    return r.select("file_md5", "attempts", "status", "reason")


def history(t: Tables):
    """Conversations through keyed state: after every batch the last messages of those that it touched."""
    m = StreamTables(t, "conversations").messages().select("conversation_id", "seq", "role", "content")
    h = _finish(t, S.chat_history(m), "history", ["conversation_id"], until=lambda path: True)
    return h.select("conversation_id", "seq", "role", F.md5("content").alias("content_md5"))


def archive(t: Tables):
    m = t.messages().withColumn("ts_text", F.when(F.col("seq") % 4 == 3, "not a time").otherwise(F.col("ts").cast("string"))).drop("ts")
    done = t.messages().filter("role = 'system'").select("conversation_id").distinct()
    a = M.archive_rows(m, done, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    return a.select("conversation_id", "seq", "role", "ts")


def fingerprints(t: Tables):
    d = t.raw("documents").select(F.md5("text").alias("file_md5"), "doc_id", F.col("n_chars").alias("total_size"))
    return SF.registry(d, F.col("doc_id"))


def object_paths(t: Tables):
    return t.files().select("file_md5", SF.document_path(F.col("user_id"), F.col("file_name")).alias("path"),
                            SF.analysis_path(F.col("user_id"), F.col("file_md5"), F.lit("vlm"), F.lit("a1")).alias("analysis_path"))


def markdown_blocks(t: Tables):
    d = t.raw("documents").select(F.col("text").alias("value"), F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").when(F.col("doc_id") % 3 == 0, "").otherwise(".txt")).alias("file_name"), F.md5(F.col("doc_id").cast("string")).alias("file_md5"))
    return SF.text_blocks(d).select("file_md5", "file_type", F.md5("text").alias("text_md5"))


def messages_roundtrip(t: Tables):
    m = topics.encode(t.parse_requests().drop("event_id"))
    raw = m.withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.monotonically_increasing_id()})
    return topics.decode(raw).groupBy("user_id", "key").agg(F.count("*").alias("n"), F.count("file_name").alias("named"))


def keyed_merge(t: Tables):
    target = t.raw("part").select((F.col("p_partkey") % 1500).alias("id"), F.col("p_partkey").alias("v")).filter("v < 1500")
    inc = t.raw("part").filter("p_partkey % 3 = 0").select((F.col("p_partkey") % 900 + 1000).alias("id"), (F.col("p_partkey") + 100000).alias("v"))
    return ST.merge_by_key(target, inc, ["id"], F.col("v"))


def replaced_files(t: Tables):
    """Two batches into a file-replacing table; the second empties some files."""
    path = scratch(t.spark, "replace")
    one = t.raw("part").select(F.md5((F.col("p_partkey") % 300).cast("string")).alias("file_md5"), "p_partkey", "p_size")
    ST.replace_files(one, one, path, 0)
    again = one.filter("p_partkey % 300 < 100")
    ST.replace_files(again.filter("p_partkey % 300 < 60").withColumn("p_size", F.col("p_size") + 1000), again, path, 1)
    return ST.current_rows(t.spark, path).select("file_md5", "p_partkey", "p_size")


def json_columns(t: Tables):
    p = F.col("p_partkey")
    lst = F.when(p % 4 == 0, "not json").when(p % 4 == 1, "{}").otherwise(F.to_json(F.array("p_name", F.lit(" "), "p_brand")))
    mp = F.when(p % 5 == 0, "[").otherwise(F.to_json(F.create_map(F.lit("n"), "p_name")))
    return t.raw("part").select("p_partkey", F.array_join(ST.json_list(lst), ",").alias("items"), F.coalesce(ST.json_map(mp)["n"], F.lit("-")).alias("name"))


def index_listing(t: Tables):
    c = t.chunks()
    return ST.listing(c, F.col("kb_profile") == "design", [F.col("file_md5"), F.col("chunk_id").desc()], 25, 50).select("file_md5", "chunk_id", "total")


def report(t: Tables):
    """Evaluation rows with their best hits nested, written as JSON and read back."""
    hits = t.raw("lineitem").select((F.col("l_orderkey") % 200).alias("case_id"), F.col("l_partkey").alias("chunk_id"), F.md5(F.col("l_partkey").cast("string")).alias("file_md5"), F.col("l_discount").alias("score"), F.lit("text").alias("text_content"), F.lit("f").alias("file_name"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"))
    from marginalia.plans.sequence import top_rows

    hits = top_rows(hits, ["case_id"], [F.col("score").desc(), F.col("chunk_id"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")], 10)
    judged = hits.select("case_id", "rank", (F.col("chunk_id") % 9 == 0).alias("relevant"))
    cases = t.raw("orders").select((F.col("o_orderkey") % 200).alias("case_id")).distinct()
    res = evaluation.case_results(cases, judged)
    path = scratch(t.spark, "report")
    ST.write_report(evaluation.retrieval_summary(res), evaluation.report_rows(res, hits), path)
    schema = "case_id bigint, hit_at_k boolean, mrr double, top_hits array<struct<rank: int, file_md5: string, score: double>>"
    back = t.spark.read.schema(schema).json(f"{path}/rows")
    return back.select("case_id", "hit_at_k", F.round("mrr", 6).alias("mrr"), F.size("top_hits").alias("n_hits"), F.element_at("top_hits", 1)["file_md5"].alias("best"))


_MON = """count(*) AS total, round(avg((status = 'error')::int), 6) AS error_rate, round(avg((status = 'no_evidence')::int), 6) AS no_evidence_rate, round(avg(latency_ms), 6) AS avg_latency"""
_ST = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"
_MD = "text"
for _p, _b in ((r"(?m)^#+\s+", ""), (r"(?m)^[-*+]\s+", ""), (r"(?s)```[^`]*```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"\*\*([^\*]+)\*\*", r"\1"), (r"\*([^\*]+)\*", r"\1")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_b}', 'g')"

QUERIES = {
    "m11_stream_monitor": (monitor_stream, with_tables(f"SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, {_MON} FROM usage_events GROUP BY 1")),
    "m11_weekly_monitor": (monitor_weekly, with_tables(f"""SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, {_MON} FROM usage_events, (SELECT unnest(range(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-20', INTERVAL 1 DAY)) AS d)
      WHERE created_at >= d AND created_at < d + INTERVAL 7 DAY GROUP BY 1""")),
    "m10_stream_upload_progress": (progress_stream, with_tables("SELECT file_md5, count(*) AS received FROM upload_parts GROUP BY 1")),
    "m02_stream_idempotence": (idempotent_stream, with_tables("SELECT DISTINCT user_id, file_md5 FROM parse_requests WHERE file_name IS NOT NULL AND user_id IS NOT NULL")),
    "m02_first_requests": (idempotent_batch, with_tables("""SELECT user_id, file_md5, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_md5 ORDER BY ts, event_id) AS r
      FROM parse_requests WHERE file_name IS NOT NULL) WHERE r = 1""")),
    "p15_request_validation": (validation, with_tables("SELECT event_id, CASE WHEN file_name IS NULL THEN 'file_name' ELSE '' END AS missing FROM parse_requests")),
    "m01_stream_ingest": (ingest_stream, with_tables(f"""SELECT c.file_md5, chunk_id, md5(text_content) AS text_md5, CASE WHEN length(ct) >= 8 THEN 35 ELSE 28 END AS quality_score, 'rejected' AS quality_status
      FROM chunks c JOIN cleaned USING (doc_id)""")),
    "m05_stream_status": (status_stream, f"""SELECT md5((event_id % 700)::varchar) AS file_md5, arg_max({_ST}, {{'t': ts, 'e': event_id}}) AS status, max(ts) AS changed_at, count(*) AS changes FROM events GROUP BY 1"""),
    "m09_idle_sessions": (sessions, """SELECT user_id, opened_at, n AS events FROM (SELECT user_id, s, min(ts) AS opened_at, count(*) AS n FROM (
      SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2)"""),
    "m04_stream_retries": (retries, with_tables(f"""SELECT file_md5, n AS attempts, CASE WHEN left(file_md5, 1) > '3' THEN {C.STATUS_DONE} WHEN n = 3 THEN {C.STATUS_FAILED} ELSE {C.STATUS_PROCESSING} END AS status,
      CASE WHEN left(file_md5, 1) > '3' THEN '' ELSE 'RuntimeError: broken file' END AS reason
      FROM (SELECT DISTINCT file_md5 FROM parse_requests), (SELECT unnest([1, 2, 3]) AS n) WHERE left(file_md5, 1) <= '3' OR n = 1""")),
    "m08_rate_limit": (rates, RATE_SQL),
    "m08_stream_rate_limit": (rate_stream, RATE_SQL),
    "m06_chat_history": (history, with_tables("""SELECT conversation_id, seq, role, md5(content) AS content_md5 FROM (
      SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS r FROM messages) WHERE r <= 20""")),
    "m07_archive": (archive, with_tables("""SELECT conversation_id, seq, role, CASE WHEN seq % 4 = 3 THEN TIMESTAMP '2024-03-01' ELSE ts END AS ts FROM messages
      WHERE conversation_id NOT IN (SELECT conversation_id FROM messages WHERE role = 'system')""")),
    "s02_fingerprints": (fingerprints, "SELECT md5(text) AS file_md5, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS total_size, count(*) AS copies FROM documents GROUP BY 1"),
    "s08_object_paths": (object_paths, with_tables("SELECT file_md5, 'documents/' || user_id || '/' || file_name AS path, 'analyses/' || user_id || '/' || file_md5 || '/vlm/a1.json' AS analysis_path FROM files")),
    "s01_text_blocks": (markdown_blocks, f"""SELECT * FROM (SELECT md5(doc_id::varchar) AS file_md5, CASE WHEN doc_id % 2 = 0 THEN 'md' WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'txt' END AS file_type,
      md5(CASE WHEN doc_id % 2 = 0 THEN {clean(_MD)} ELSE {clean('text')} END) AS text_md5 FROM documents) WHERE text_md5 <> md5('')"""),
    "s03_s04_messages": (messages_roundtrip, with_tables("SELECT user_id, file_md5 AS key, count(*) AS n, count(file_name) AS named FROM parse_requests GROUP BY 1, 2")),
    "s06_keyed_merge": (keyed_merge, """WITH t AS (SELECT p_partkey AS id, p_partkey AS v FROM part WHERE p_partkey < 1500),
      i AS (SELECT p_partkey % 900 + 1000 AS id, max(p_partkey + 100000) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT * FROM t WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i"""),
    "s07_replace_files": (replaced_files, """SELECT md5((p_partkey % 300)::varchar) AS file_md5, p_partkey, CASE WHEN p_partkey % 300 < 60 THEN p_size + 1000 ELSE p_size END AS p_size
      FROM part WHERE p_partkey % 300 < 60 OR p_partkey % 300 >= 100"""),
    "s12_json_columns": (json_columns, """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN '' ELSE p_name || ',' || p_brand END AS items, CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE p_name END AS name FROM part"""),
    "s11_index_listing": (index_listing, with_tables("""SELECT file_md5, chunk_id, (SELECT count(*) FROM chunks WHERE kb_profile = 'design') AS total FROM chunks WHERE kb_profile = 'design'
      ORDER BY file_md5, chunk_id DESC LIMIT 50 OFFSET 25""")),
    "s10_report": (report, """WITH h AS (SELECT l_orderkey % 200 AS case_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_discount DESC, l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS rank FROM lineitem),
      c AS (SELECT case_id, min(rank) FILTER (l_partkey % 9 = 0) AS f, least(count(*), 5) AS n, arg_min(l_partkey, rank) AS b FROM h WHERE rank <= 10 GROUP BY 1)
      SELECT case_id, f IS NOT NULL AS hit_at_k, round(coalesce(1.0::double / f, 0), 6) AS mrr, n AS n_hits, md5(b::varchar) AS best FROM c"""),
}
