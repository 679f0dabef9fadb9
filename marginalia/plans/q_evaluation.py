"""Registered queries: online and offline evaluation, uploads, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.operators import evaluation as E
from marginalia.plans.oracle import with_tables
from marginalia.plans.tables import Tables

AS_OF, DAYS = "2024-01-31 00:00:00", 30


def _events(t: Tables):
    return E.in_window(t.usage_events(), AS_OF, DAYS)


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def online(t: Tables):
    return _round(E.online_summary(_events(t), ["selected_profile"]), "avg_latency", "retrieval_hit_rate", "with_sources_rate")


def p95_by_user(t: Tables):
    return E.rank_percentile(t.usage_events(), ["user_id"], "latency_ms", "p95_latency")


def intents(t: Tables):
    return E.top_intents(_events(t), 12)


def daily(t: Tables):
    return _round(E.daily_stats(_events(t)), "avg_latency")


def samples(t: Tables):
    return E.failing_samples(_events(t), 20).select("event_id", "status", "question_text", "created_at")


def metrics(t: Tables):
    m = t.raw("lineitem").groupBy((F.col("l_orderkey") % 40).alias("run_id"), F.concat(F.lit("m_"), "l_returnflag").alias("metric_key")).agg(
        F.round(F.avg("l_discount"), 8).alias("metric_value")
    )
    return m.filter("(run_id + length(metric_key)) % 3 <> 0 or metric_key <> 'm_A'").withColumn(
        "threshold", F.when(F.col("run_id") % 4 != 0, F.lit(0.05))
    )


def cases(t: Tables):
    return t.raw("lineitem").select(
        (F.col("l_orderkey") % 40).alias("run_id"), F.col("l_partkey").alias("case_id"), (F.col("l_tax") < 0.05).alias("passed")
    )


def coverage(t: Tables):
    return t.raw("part").groupBy((F.col("p_partkey") % 40).alias("run_id"), F.col("p_type").alias("asset_type")).agg(
        F.count("*").alias("total_count"), F.count_if(F.col("p_size") > 25).alias("indexed_count")
    )


METRIC_STEPS = {"metrics": """SELECT *, CASE WHEN run_id % 4 <> 0 THEN 0.05::double END AS threshold FROM (
    SELECT l_orderkey % 40 AS run_id, 'm_' || l_returnflag AS metric_key, round(avg(l_discount), 8) AS metric_value
    FROM lineitem GROUP BY 1, 2) WHERE (run_id + length(metric_key)) % 3 <> 0 OR metric_key <> 'm_A'"""}


def runs(t: Tables):
    r = t.raw("orders").select((F.col("o_orderkey") % 45).alias("run_id")).distinct()
    return _round(E.run_overview(r, metrics(t), cases(t), coverage(t)), "pass_rate")


RUNS_SQL = with_tables("""SELECT r.run_id, coalesce(n_metrics, 0) AS n_metrics, coalesce(n_cases, 0) AS n_cases,
  coalesce(n_passed, 0) AS n_passed, coalesce(n_coverage, 0) AS n_coverage,
  CASE WHEN n_cases > 0 THEN round(n_passed / n_cases::double, 6) ELSE 0 END AS pass_rate
FROM (SELECT DISTINCT o_orderkey % 45 AS run_id FROM orders) r
LEFT JOIN (SELECT run_id, count(*) AS n_metrics FROM metrics GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT l_orderkey % 40 AS run_id, count(*) AS n_cases, count(*) FILTER (l_tax < 0.05::double) AS n_passed FROM lineitem GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT p_partkey % 40 AS run_id, count(DISTINCT p_type) AS n_coverage FROM part GROUP BY 1) USING (run_id)""", METRIC_STEPS)


def coverage_rates(t: Tables):
    given = F.when(F.col("run_id") % 7 == 0, F.lit(0.5))
    total = F.when(F.col("run_id") % 5 == 0, F.lit(0)).otherwise(F.col("total_count"))
    return coverage(t).select(
        "run_id", "asset_type", F.round(E.coverage_rate(given, F.col("indexed_count"), total), 6).alias("coverage_rate")
    )


def replaced(t: Tables):
    m = metrics(t).select("run_id", "metric_key", "metric_value")
    new = t.raw("part").filter("p_partkey % 2 = 0").groupBy((F.col("p_partkey") % 60).alias("run_id"), F.col("p_brand").alias("metric_key")).agg(
        F.round(F.avg("p_size"), 8).alias("metric_value")
    )
    return E.replace_by(m, new, ["run_id"])


def trend(t: Tables):
    return E.metric_trend(metrics(t), 8)


def totals(t: Tables):
    counted = E.file_counts(t.files().select("file_md5"), _parts(t))
    return E.totals(counted, ["chunks", "blocks", "pages", "quality"])


def _parts(t: Tables):
    return {"chunks": t.chunks(), "blocks": t.blocks(), "pages": t.visual_pages(), "quality": t.chunk_quality()}


def counts(t: Tables):
    return E.file_counts(t.files().select("file_md5", "file_name"), _parts(t))


COUNT_STEPS = {"counted": " UNION ALL ".join(
    f"SELECT file_md5, '{k}' AS kind FROM {s}" for k, s in
    (("chunks", "chunks"), ("blocks", "blocks"), ("pages", "visual_pages"), ("quality", "chunk_quality"))
)}
_COUNT_COLS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("chunks", "blocks", "pages", "quality"))


def progress(t: Tables):
    return _round(E.upload_progress(t.upload_parts(), t.upload_totals()), "progress")


def missing(t: Tables):
    return E.missing_parts(t.upload_parts(), t.upload_totals())


def bitmaps(t: Tables):
    return E.upload_bitmaps(t.upload_parts()).select("file_md5", "received")


def history(t: Tables):
    return E.last_messages(t.messages(), 3).select("conversation_id", "seq", "role", "age")


def history_range(t: Tables):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.messages().filter(E.in_iso_range(iso, "2024-01-02T00:00:00", "2024-01-05")).select("conversation_id", "seq")


def conv_list(t: Tables):
    archived = t.messages().filter("role = 'system'").select("conversation_id").distinct().withColumn("archived", F.lit(True))
    return E.conversation_counts(t.messages()).join(archived, "conversation_id", "left").fillna(False, ["archived"])


def case_lines(t: Tables):
    k = F.col("item_id")
    js = F.to_json(F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("case-"), k)).alias("id"),
        F.when(k % 10 != 9, F.col("text")).otherwise("  ").alias("query"),
        F.when(k % 4 != 0, k % 7).alias("top_k"),
        F.struct(F.array(F.md5(k.cast("string"))).alias("file_md5_any")).alias("expected"),
    ))
    line = F.when(k % 11 == 0, "  ").when(k % 13 == 0, F.concat(F.lit("# "), js)).otherwise(F.concat(F.lit(" "), js))
    c = E.parse_cases(t.raw("benchmark").select((k + 1).alias("line_no"), line.alias("value")))
    return c.select(
        "case_id", F.md5("query").alias("query_md5"), "top_k", F.element_at("expected.file_md5_any", 1).alias("md5_any"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


CASES_SQL = r"""SELECT CASE WHEN item_id % 3 <> 0 THEN 'case-' || item_id ELSE 'line-' || (item_id + 1) END AS case_id,
  md5(CASE WHEN item_id % 10 <> 9 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END) AS query_md5,
  CASE WHEN item_id % 4 <> 0 AND item_id % 7 <> 0 THEN item_id % 7 ELSE 10 END AS top_k, md5(item_id::varchar) AS md5_any,
  CASE WHEN item_id % 10 = 9 THEN 'query is required' ELSE '' END AS error
FROM benchmark WHERE item_id % 11 <> 0 AND item_id % 13 <> 0"""


def chunk_files(t: Tables):
    return t.raw("part").select(F.md5((F.col("p_partkey") % 300).cast("string")).alias("file_md5"), "p_partkey", "p_size").join(
        t.files().select("file_md5", "file_name", "kb_profile"), "file_md5"
    ).filter("kb_profile <> 'policy'")


def part_rows(t: Tables):
    """Rows of readable files only, with their file and decoded payload."""
    mine = t.raw("labels").filter("quality = 1").select(F.md5(F.col("doc_id").cast("string")).alias("file_md5"))
    rows = t.raw("part").select(
        F.md5((F.col("p_partkey") % 500).cast("string")).alias("file_md5"), F.col("p_partkey").alias("row_no"),
        F.to_json(F.struct(F.col("p_name").alias("task"), F.col("p_size").alias("confidence"))).alias("row_json"))
    found = rows.join(mine, "file_md5", "left_semi").join(t.files().select("file_md5", "file_name", "kb_profile"), "file_md5")
    p = F.from_json("row_json", "task string, confidence double")
    return found.withColumn("p", p).select("file_md5", "row_no", "file_name", "kb_profile", "p.task", "p.confidence")


def overridden(t: Tables):
    """File name and profile of the registry where there is one, else what the hit says."""
    hits = t.raw("part").select(F.md5((F.col("p_partkey") % 1300).cast("string")).alias("file_md5"), "p_partkey", F.col("p_name").alias("file_name"), F.col("p_type").alias("kb_profile"))
    f = t.files().select("file_md5", F.col("file_name").alias("_n"), F.col("kb_profile").alias("_p"))
    return hits.join(f, "file_md5", "left").select("p_partkey", F.coalesce("_n", "file_name").alias("file_name"), F.coalesce("_p", "kb_profile").alias("kb_profile"))


def sorted_detail(t: Tables, asked: int = 900):
    """Several keys with nulls last, and the limit clamped to 1..500."""
    rows = t.raw("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("page"), "o_orderpriority")
    return rows.orderBy(F.col("o_orderpriority").asc_nulls_last(), F.col("page").asc_nulls_last(), "o_orderkey").limit(max(1, min(asked, 500)))


def profile_parameters(t: Tables):
    """The parameters of a file's profile, legacy and unknown names mapped first."""
    legacy = F.create_map(*[F.lit(x) for kv in C.LEGACY_PROFILES.items() for x in kv])
    named = F.when(F.col("doc_id") % 6 == 0, "resume").when(F.col("doc_id") % 6 == 1, "legal").when(F.col("doc_id") % 6 == 2, "nothing")
    f = t.raw("documents").select("doc_id", F.coalesce(named, t.file_columns()["kb_profile"]).alias("given"))
    known = [p[0] for p in C.PROFILES]
    f = f.withColumn("profile_id", F.when(F.col("given").isin(known), F.col("given")).otherwise(F.coalesce(legacy[F.col("given")], F.lit(C.DEFAULT_PROFILE))))
    prof = t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS)
    return f.join(F.broadcast(prof), "profile_id").select("doc_id", "profile_id", "chunk_size", "chunk_overlap", "ocr_min_chars", "ocr_max_pages", "enable_relation_index")


_WIN = "usage_events WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"

QUERIES = {
    "a01_file_counts": (counts, with_tables(f"SELECT f.file_md5, f.file_name, {_COUNT_COLS} FROM files f LEFT JOIN counted c ON c.file_md5 = f.file_md5 GROUP BY 1, 2", COUNT_STEPS)),
    "a03_a05_online_summary": (online, with_tables(f"""SELECT selected_profile, count(*) AS total, count(*) FILTER (status = 'success') AS success,
      count(*) FILTER (status = 'no_evidence') AS no_evidence, count(*) FILTER (status = 'error') AS error,
      count(*) FILTER (status = 'archived') AS archived, round(avg(latency_ms), 6) AS avg_latency,
      list_sort(list(latency_ms))[greatest(1, floor(0.95 * count(*)))::int]::double AS p95_latency,
      round(avg((retrieval_count > 0)::int), 6) AS retrieval_hit_rate, round(avg((source_count > 0)::int), 6) AS with_sources_rate
      FROM {_WIN} GROUP BY 1""")),
    "a04_p95_latency": (p95_by_user, with_tables("""SELECT user_id,
      list_sort(list(latency_ms))[greatest(1, floor(0.95 * count(*)))::int]::double AS p95_latency FROM usage_events GROUP BY 1""")),
    "a06_top_intents": (intents, with_tables(f"""SELECT intent, n FROM (SELECT CASE WHEN trim(intent) = '' THEN 'unknown' ELSE intent END AS intent,
      count(*) AS n, min(created_at) AS f FROM {_WIN} GROUP BY 1) ORDER BY n DESC, f LIMIT 12""")),
    "a07_daily_stats": (daily, with_tables(f"""SELECT created_at::date AS day, count(*) AS total, count(*) FILTER (status = 'success') AS success,
      count(*) FILTER (status = 'no_evidence') AS no_evidence, count(*) FILTER (status = 'error') AS error,
      round(avg(latency_ms), 6) AS avg_latency FROM {_WIN} GROUP BY 1""")),
    "t03_failing_samples": (samples, with_tables(f"""SELECT event_id, status, question_text, created_at FROM {_WIN}
      AND status IN ('no_evidence', 'error') ORDER BY created_at DESC, event_id DESC LIMIT 20""")),
    "a08_run_overview": (runs, RUNS_SQL),
    "a09_coverage_rates": (coverage_rates, """SELECT run_id, asset_type, round(CASE WHEN run_id % 7 = 0 THEN 0.5 WHEN run_id % 5 = 0 THEN 0
      ELSE i::double / n END, 6)::double AS coverage_rate FROM (SELECT p_partkey % 40 AS run_id, p_type AS asset_type,
      count(*) AS n, count(*) FILTER (p_size > 25) AS i FROM part GROUP BY 1, 2)"""),
    "a22_totals": (totals, with_tables("""SELECT sum(n) FILTER (k = 1)::bigint AS chunks, sum(n) FILTER (k = 2)::bigint AS blocks,
      sum(n) FILTER (k = 3)::bigint AS pages, sum(n) FILTER (k = 4)::bigint AS quality FROM (
      SELECT 1 AS k, count(*) AS n FROM chunks UNION ALL SELECT 2, count(*) FROM blocks
      UNION ALL SELECT 3, count(*) FROM visual_pages WHERE file_md5 IN (SELECT file_md5 FROM files) UNION ALL SELECT 4, count(*) FROM chunk_quality)""")),
    "n09_replace_by_run": (replaced, with_tables("""SELECT run_id, metric_key, metric_value FROM metrics WHERE run_id NOT IN (SELECT run_id FROM fresh)
      UNION ALL SELECT * FROM fresh""", {**METRIC_STEPS, "fresh": """SELECT p_partkey % 60 AS run_id, p_brand AS metric_key,
      round(avg(p_size), 8) AS metric_value FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2"""})),
    "n10_metric_trend": (trend, with_tables("""SELECT *, coalesce(metric_value >= threshold, true) AS passed,
      coalesce(metric_value < previous_value, false) AS regressed FROM (SELECT *, lag(metric_value) OVER (PARTITION BY metric_key ORDER BY run_id) AS previous_value FROM metrics)""", METRIC_STEPS)),
    "a25_upload_progress": (progress, with_tables("""SELECT file_md5, total_chunks, coalesce(n, 0) AS received,
      round(coalesce(n, 0) / total_chunks::double, 6) AS progress, coalesce(n, 0) = total_chunks AS mergeable
      FROM upload_totals LEFT JOIN (SELECT file_md5, count(*) AS n FROM upload_parts GROUP BY 1) USING (file_md5)""")),
    "a25_upload_bitmaps": (bitmaps, with_tables("SELECT file_md5, count(*) AS received FROM upload_parts GROUP BY 1")),
    "u05_missing_parts": (missing, with_tables("""SELECT file_md5, chunk_index FROM (SELECT file_md5, unnest(range(total_chunks)) AS chunk_index
      FROM upload_totals) w ANTI JOIN upload_parts p USING (file_md5, chunk_index)""")),
    "w12_last_messages": (history, with_tables("""SELECT conversation_id, seq, role, age FROM (SELECT *,
      row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS age FROM messages) WHERE age <= 3""")),
    "p07_history_range": (history_range, with_tables("""SELECT conversation_id, seq FROM messages
      WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '2024-01-02T00:00:00' AND '2024-01-05'""")),
    "a24_j19_conversations": (conv_list, with_tables("""SELECT conversation_id, count(*) AS message_count, max(ts) AS last_message_time,
      bool_or(role = 'system') AS archived FROM messages GROUP BY 1""")),
    "s09_case_lines": (case_lines, CASES_SQL),
    "j02_j11_rows_of_files": (part_rows, with_tables("""SELECT f.file_md5, p_partkey AS row_no, file_name, kb_profile, p_name AS task, p_size::double AS confidence FROM part
      JOIN files f ON f.doc_id = p_partkey % 500 WHERE f.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")),
    "j04_file_override": (overridden, with_tables("""SELECT p_partkey, coalesce(file_name, p_name) AS file_name, coalesce(kb_profile, p_type) AS kb_profile
      FROM part LEFT JOIN files ON doc_id = p_partkey % 1300""")),
    "t01_t02_sorted_detail": (sorted_detail, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS page, o_orderpriority FROM orders
      ORDER BY o_orderpriority NULLS LAST, page NULLS LAST, o_orderkey LIMIT 500"""),
    "c09_profile_parameters": (profile_parameters, """SELECT doc_id, profile_id, CASE profile_id WHEN 'design' THEN 1100 WHEN 'policy' THEN 950 ELSE 900 END AS chunk_size,
      CASE profile_id WHEN 'design' THEN 150 WHEN 'policy' THEN 140 ELSE 120 END AS chunk_overlap, CASE profile_id WHEN 'design' THEN 100 WHEN 'policy' THEN 80 ELSE 70 END AS ocr_min_chars,
      CASE profile_id WHEN 'design' THEN 25 WHEN 'policy' THEN 15 ELSE 12 END AS ocr_max_pages, profile_id <> 'policy' AS enable_relation_index
      FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'policy' WHEN 2 THEN 'general' ELSE ['general','design','policy','ops'][doc_id % 4 + 1] END AS profile_id FROM documents)"""),
    "j01_rows_with_files": (chunk_files, with_tables("""SELECT f.file_md5, p_partkey, p_size, file_name, kb_profile
      FROM part JOIN files f ON f.doc_id = p_partkey % 300 WHERE kb_profile <> 'policy'""")),
}
