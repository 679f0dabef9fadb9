"""Registered queries: blocks, chunks, parents, per-file structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import text as X
from marginalia.operators import blocks as B
from marginalia.operators import chunking as K
from marginalia.plans.oracle import clean, has_any, with_tables
from marginalia.plans.q_text import preview_sql
from marginalia.plans.sequence import ordered_concat
from marginalia.plans.tables import Tables


def all_blocks(t: Tables):
    return B.enrich(t.blocks().drop("doc_id", "lang").unionByName(t.part_blocks().drop("row_no")))


def units(t: Tables):
    kinds = ["xlsx", "pdf", "docx", "txt"]
    e = t.raw("lineitem").select(
        F.md5(F.col("l_orderkey").cast("string")).alias("file_md5"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_index"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("file_type"),
        F.when(F.col("l_returnflag") == "R", "image_ocr").otherwise("text").alias("type"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("page"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit(" s"), F.col("l_suppkey") % 7)).alias("sheet"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linestatus")).alias("section"),
    )
    c = F.col
    u = B.document_unit(c("file_type"), c("type"), c("page"), B.filled(c("sheet")), B.filled(c("section")), c("block_index"))
    d = e.select(u.alias("u")).select("u.*")
    return d.groupBy("unit_type", "unit_key", "unit_name", "unit_order").agg(F.count("*").alias("n"))


UNITS_SQL = """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS bi, ['xlsx','pdf','docx','txt'][l_partkey % 4 + 1] AS ft,
  l_returnflag = 'R' AS img, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END AS page,
  CASE WHEN l_suppkey % 3 = 0 THEN 's' || (l_suppkey % 7) END AS sh, CASE WHEN l_suppkey % 5 = 0 THEN l_linestatus END AS se FROM lineitem),
k AS (SELECT *, CASE WHEN ft = 'xlsx' AND coalesce(sh, se) IS NOT NULL THEN 'sheet:' || coalesce(sh, se)
  WHEN ft IN ('xlsx', 'pdf') AND page IS NOT NULL THEN 'page:' || page WHEN ft = 'xlsx' THEN 'sheet:workbook'
  WHEN ft IN ('pdf', 'docx') AND se IS NOT NULL THEN 'section:' || se WHEN ft = 'docx' THEN 'section:document'
  WHEN img THEN 'image:image:' || coalesce(sh, page::varchar, bi::varchar) ELSE 'document:root' END AS full_key FROM e)
SELECT split_part(full_key, ':', 1) AS unit_type, CASE WHEN full_key LIKE 'image:%' THEN substr(full_key, 7) ELSE full_key END AS unit_key,
  CASE WHEN full_key LIKE 'page:%' THEN 'page_' || split_part(full_key, ':', 2) WHEN full_key LIKE 'image:%' THEN substr(full_key, 7)
    ELSE split_part(full_key, ':', 2) END AS unit_name,
  CASE WHEN full_key LIKE 'page:%' OR full_key LIKE 'image:%' THEN page END AS unit_order, count(*) AS n FROM k GROUP BY 1, 2, 3, 4"""


def quality(t: Tables):
    return all_blocks(t).select(
        "file_md5", "block_index", "type", "quality_score", "quality_status", "document_unit_key",
        F.array_join("validation_flags", ",").alias("flags"),
    )


SCORED = {
    "scored": f"""SELECT file_md5, block_index, type, ct, score, CASE WHEN score >= 80 THEN 'accepted' WHEN score >= 60 THEN 'weak' ELSE 'rejected' END AS status,
      unit_key, flags, parser FROM (
      SELECT file_md5, block_index, type, ct, 'document:root' AS unit_key, 'tika' AS parser,
        CASE WHEN ct = '' THEN least(16 + 8, 45) ELSE 18 + CASE WHEN length(ct) >= 8 THEN 7 ELSE 0 END + 16 + 10 + 8 END AS score,
        CASE WHEN ct = '' THEN 'empty_text' ELSE '' END AS flags
      FROM (SELECT *, {clean('text')} AS ct FROM blocks)
      UNION ALL SELECT file_md5, block_index, type, text AS ct, 'sheet:' || sheet, 'xlsx',
        25 + 16 + 14 + CASE WHEN type = 'table_row' THEN 25 ELSE 0 END,
        CASE WHEN type = 'schedule_row' THEN 'missing_schedule_task,missing_schedule_period' ELSE '' END FROM part_blocks)""",
}


def by_file(t: Tables):
    return B.quality_by_file(all_blocks(t))


def parents(t: Tables):
    p = B.parent_chunks(all_blocks(t))
    return p.select(
        "file_md5", "document_unit_key", "parent_chunk_id", "chunk_type", F.md5("text_content").alias("text_md5"),
        "quality_score", "quality_status", F.md5("block_indexes").alias("indexes_md5"),
        F.array_join("source_parsers", ",").alias("parsers"),
    )


PARENTS_SQL = with_tables(f"""SELECT file_md5, unit_key AS document_unit_key, parent_chunk_id, split_part(unit_key, ':', 1) || '_context' AS chunk_type,
  md5({clean('body')}) AS text_md5, quality_score, quality_status, md5(idx) AS indexes_md5, parsers FROM (
  SELECT file_md5, unit_key, row_number() OVER (PARTITION BY file_md5 ORDER BY min(block_index)) - 1 AS parent_chunk_id,
    string_agg(ct, chr(10) || chr(10) ORDER BY block_index) FILTER (ct <> '') AS body,
    round_even(avg(score), 0)::int AS quality_score,
    CASE WHEN bool_or(status <> 'accepted') THEN 'weak' ELSE 'accepted' END AS quality_status,
    string_agg(block_index::varchar, ',' ORDER BY block_index) AS idx, min(parser) AS parsers
  FROM scored GROUP BY file_md5, unit_key) WHERE body IS NOT NULL""", SCORED)


def windows(t: Tables):
    return t.chunks().select("file_md5", "chunk_id", F.length("text_content").alias("n_chars"), F.md5("text_content").alias("text_md5"))


def packed(t: Tables):
    return K.pack_blocks(all_blocks(t)).select(
        "file_md5", "chunk_id", F.md5("text_content").alias("text_md5"), "chunk_type", "document_unit_key",
        "quality_score", "quality_status", F.size("sources").alias("n_sources"),
    )


PACK_STEPS = {
    **SCORED,
    "body": """SELECT *, row_number() OVER (PARTITION BY file_md5 ORDER BY block_index) AS pos, length(ct) AS n,
      CASE WHEN unit_key LIKE 'sheet:%' THEN unit_key END AS sh FROM scored WHERE ct <> ''""",
    "pack": """SELECT file_md5, pos, pos AS start, CASE WHEN n > 1800 THEN NULL ELSE n END AS cur, sh FROM body WHERE pos = 1
      UNION ALL SELECT b.file_md5, b.pos,
        CASE WHEN b.n > 1800 OR p.cur IS NULL OR p.cur + 2 + b.n > 900 OR b.sh <> p.sh THEN b.pos ELSE p.start END,
        CASE WHEN b.n > 1800 THEN NULL WHEN p.cur IS NULL OR p.cur + 2 + b.n > 900 OR b.sh <> p.sh THEN b.n ELSE p.cur + 2 + b.n END,
        b.sh FROM pack p JOIN body b ON b.file_md5 = p.file_md5 AND b.pos = p.pos + 1""",
    "grp": """SELECT file_md5, start, string_agg(ct, chr(10) || chr(10) ORDER BY pos) AS joined, max(n) AS n, count(*) AS k,
      CASE WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE min(type) END AS chunk_type, arg_min(unit_key, pos) AS unit_key,
      max(score) AS score, CASE WHEN bool_or(status = 'rejected') THEN 'rejected' WHEN bool_or(status = 'weak') THEN 'weak' ELSE 'accepted' END AS status
      FROM body JOIN pack USING (file_md5, pos) GROUP BY file_md5, start""",
    "cutp": f"""SELECT *, list_filter(CASE WHEN n > 1800 THEN
        list_transform(list_concat(list_transform(range(0, greatest(ceil((length(joined) - 900) / 780.0), 0)::int + 1),
          lambda i: i * 780), [length(joined) - 120]), lambda s: {clean('substr(joined, s + 1, 900)')})
        ELSE [{clean('joined')}] END, lambda p: p <> '') AS ps FROM grp""",
    "rows_": "SELECT *, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM cutp",
}
PACKED_SQL = with_tables("""SELECT file_md5, (row_number() OVER (PARTITION BY file_md5 ORDER BY start, i) - 1)::int AS chunk_id, md5(piece) AS text_md5,
  chunk_type, unit_key AS document_unit_key, score AS quality_score, status AS quality_status, k AS n_sources FROM rows_""", PACK_STEPS)


def children(t: Tables):
    b = all_blocks(t)
    c = B.child_chunks(K.pack_blocks(b), B.parent_chunks(b))
    return c.select("file_md5", "chunk_id", "parent_chunk_id", "neighbor_prev_id", "neighbor_next_id", "quality_status")


CHILD_SQL = with_tables("""SELECT file_md5, chunk_id, parent_chunk_id, quality_status,
  CASE WHEN lag(parent_chunk_id) OVER w IS NOT DISTINCT FROM parent_chunk_id THEN lag(chunk_id) OVER w END AS neighbor_prev_id,
  CASE WHEN lead(parent_chunk_id) OVER w IS NOT DISTINCT FROM parent_chunk_id THEN lead(chunk_id) OVER w END AS neighbor_next_id
FROM kids WINDOW w AS (PARTITION BY file_md5 ORDER BY chunk_id)""", {
    **PACK_STEPS,
    "par": """SELECT file_md5, unit_key, row_number() OVER (PARTITION BY file_md5 ORDER BY min(block_index)) - 1 AS parent_chunk_id,
      bool_or(ct <> '') AS has_text FROM scored GROUP BY file_md5, unit_key""",
    "kids": """SELECT r.file_md5, (row_number() OVER (PARTITION BY r.file_md5 ORDER BY start, i) - 1)::int AS chunk_id,
      parent_chunk_id, status AS quality_status FROM rows_ r LEFT JOIN par p ON p.file_md5 = r.file_md5 AND p.unit_key = r.unit_key AND has_text""",
})


def sources(t: Tables):
    s = B.chunk_sources(K.pack_blocks(all_blocks(t)))
    return s.select(
        "file_md5", "chunk_id", "source_order", "block_index", "source_type", F.md5("text_preview").alias("preview_md5")
    )


_X = "left(CASE WHEN len(ps) > 1 THEN piece ELSE ct END, 500)"
SOURCES_SQL = with_tables(f"""SELECT r.file_md5, chunk_id, row_number() OVER (PARTITION BY r.file_md5, chunk_id ORDER BY pos) - 1 AS source_order, block_index, type AS source_type,
  md5(left(CASE WHEN type LIKE '%row%' THEN {preview_sql(_X)} ELSE {clean(_X)} END, 500)) AS preview_md5
FROM (SELECT *, (row_number() OVER (PARTITION BY file_md5 ORDER BY start, i) - 1)::int AS chunk_id FROM rows_) r
JOIN (SELECT file_md5, block_index, type, ct, pos, start FROM body JOIN pack USING (file_md5, pos)) b ON b.file_md5 = r.file_md5 AND b.start = r.start""", PACK_STEPS)


def parser_use(t: Tables):
    return B.parser_counts(B.chunk_sources(K.pack_blocks(all_blocks(t))))


def routing(t: Tables):
    q = B.router_quality(all_blocks(t).withColumn(
        "file_type", F.when(F.ascii("file_md5") % 3 == 0, "docx").otherwise(F.col("file_type"))))
    media = F.ascii("file_md5") % 4
    profile = F.when(F.ascii("file_md5") % 2 == 0, "design").otherwise("general")
    r = B.route_flags(q, media, profile, F.ascii("file_md5") % 5 == 0)
    return r.withColumn("avg_chars", F.round("avg_chars", 6))


ROUTING_SQL = with_tables("""SELECT file_md5, file_type, text_blocks, total_chars, table_like, schedule_like, 0 AS diagram_like, 0 AS image_like, avg_chars,
  (xl OR dx) AND (weak OR (media >= 2 AND schedule_like = 0)) AS escalate,
  CASE WHEN NOT (xl OR dx) OR (dx AND media <= 0) THEN false WHEN (xl AND a % 5 = 0) OR (dx AND total_chars < 1500) THEN true
    ELSE (CASE WHEN weak THEN 2 ELSE 0 END + CASE WHEN dx AND media >= 2 THEN 1 ELSE 0 END
      + CASE WHEN table_like + schedule_like < 2 THEN 1 ELSE 0 END + CASE WHEN a % 2 = 0 THEN 1 ELSE 0 END) >= 2 END AS analyse_pages
FROM (SELECT *, file_type = 'xlsx' AS xl, file_type = 'docx' AS dx, a % 4 AS media, total_chars < 1200 OR avg_chars < 40 AS weak FROM (
  SELECT file_md5, ascii(file_md5) AS a, CASE WHEN ascii(file_md5) % 3 = 0 THEN 'docx' WHEN min(parser) = 'tika' THEN 'txt' ELSE 'xlsx' END AS file_type,
    count(*) FILTER (ct <> '') AS text_blocks, sum(length(ct))::bigint AS total_chars,
    count(*) FILTER (type LIKE '%table%') AS table_like, count(*) FILTER (type LIKE '%schedule%') AS schedule_like,
    coalesce(round(sum(length(ct))::double / nullif(count(*) FILTER (ct <> ''), 0), 6), 0) AS avg_chars
  FROM scored GROUP BY file_md5))""", SCORED)


def rows_from_blocks(t: Tables):
    b = t.part_blocks().withColumn("row_json", F.when(F.col("row_no") % 2 == 0, F.col("row_json")))
    r = B.table_rows(b)
    return r.select(
        "file_md5", "sheet", "row_no", F.col("row_json")["name"].alias("name"), F.size("row_json").alias("n_fields"),
        "source_parser",
    )


def gate(t: Tables):
    # every paragraph sentence becomes a line, and some documents get arrows, so all signals occur
    text = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"[,.] ", "\n")).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(text, F.lit("\na -> b"))).otherwise(text)
    b = t.raw("documents").select(
        F.md5(F.col("doc_id").cast("string")).alias("file_md5"), F.lit("text").alias("type"),
        F.lit("tika").alias("source_parser"), text.alias("text"),
    )
    f = t.files().withColumn("file_name", F.when(F.col("user_id") == 3, "Flow chart").otherwise(F.col("file_name")))
    return B.relation_gate(f, b)


_WORDS = [w.lower() for ws in C.RELATION_KEYWORDS.values() for w in ws]
GATE_SQL = with_tables(f"""SELECT f.file_md5, (f.user_id = 3 OR coalesce((short::double / nullif(n, 0) > 0.35)::int, 0) + (words >= 3)::int + (arrows >= 1)::int >= 2) AS build
FROM files f JOIN st USING (doc_id)""", {
    "lns": r"""SELECT doc_id, regexp_replace(unnest(string_split(t, chr(10))), '^\s+|\s+$', '', 'g') AS l FROM (SELECT doc_id,
      CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[,.] ', chr(10), 'g') ELSE text END || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'a -> b' ELSE '' END AS t FROM documents)""",
    "st": f"""SELECT doc_id, count(*) FILTER (l <> '') AS n, count(*) FILTER (length(l) BETWEEN 1 AND 28) AS short,
      count(*) FILTER ({has_any('lower(l)', _WORDS)}) AS words, count(*) FILTER ({has_any('l', C.ARROWS)}) AS arrows FROM lns GROUP BY 1""",
})


def pages_of(t: Tables):
    """Pages of 20 lines; some are emptied so that streaks occur."""
    b = t.blocks().withColumn("text", F.when((F.col("doc_id") + F.col("page")) % 5 < 2, "").otherwise(F.col("text")))
    p = ordered_concat(b.withColumn("pg", F.col("page")), ["file_md5", "pg"], "block_index", F.col("text"), "\n", "text")
    f = t.files().select("file_md5", "kb_profile")
    return p.join(f, "file_md5").withColumnRenamed("pg", "page")


def page_routing(t: Tables):
    prof = t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS)
    r = B.page_routing(pages_of(t), prof)
    return r.withColumn("weak_ratio", F.round("weak_ratio", 6))


PAGE_SQL = with_tables("""SELECT file_md5, page, chars, words, no_text_streak, weak, round(weak_ratio, 6) AS weak_ratio, forced,
  coalesce((forced OR weak) AND row_number() OVER (PARTITION BY file_md5, forced OR weak ORDER BY page) <= ocr_max_pages, false) AS ocr
FROM (SELECT *, weak_ratio >= ocr_doc_trigger_ratio AS forced FROM (SELECT *, avg(weak::int) OVER (PARTITION BY file_md5) AS weak_ratio FROM wk))""", {
    "pg": f"""SELECT doc_id, md5(doc_id::varchar) AS file_md5, page, {clean("string_agg(CASE WHEN (doc_id + page) % 5 < 2 THEN '' ELSE text END, chr(10) ORDER BY block_index)")} AS ct
      FROM blocks GROUP BY doc_id, page""",
    "qu": """SELECT *, length(ct) AS chars, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]')))::double / len(w) ELSE 0 END AS ratio
      FROM (SELECT *, regexp_extract_all(ct, '[A-Za-z0-9]{2,}') AS w FROM pg)""",
    "sk": """SELECT *, page - coalesce(max(CASE WHEN chars > 0 THEN page END) OVER (PARTITION BY file_md5 ORDER BY page), 0) AS no_text_streak FROM qu""",
    "wk": """SELECT s.*, p.*, (chars < ocr_min_chars OR words < ocr_min_words OR ratio < ocr_min_valid_ratio OR no_text_streak >= ocr_no_text_streak) AS weak
      FROM sk s JOIN profiles p ON p.profile_id = ['general','design','policy','ops'][doc_id % 4 + 1]""",
})


def sections(t: Tables):
    style = F.when(F.length("text") < 60, "Heading 1").otherwise("Normal")
    p = t.blocks().select("file_md5", F.col("block_index").alias("position"), "text", style.alias("style"))
    return B.carry_sections(p).select("file_md5", "position", F.coalesce("section", F.lit("")).alias("section"))


def distinct_units(t: Tables):
    return all_blocks(t).select("file_md5", "document_unit_key").distinct()


QUERIES = {
    "f10_document_units": (units, UNITS_SQL),
    "f11_c03_block_quality": (quality, with_tables("SELECT file_md5, block_index, type, score AS quality_score, status AS quality_status, unit_key AS document_unit_key, flags FROM scored", SCORED)),
    "a02_quality_by_file": (by_file, with_tables("""SELECT file_md5, count(*) AS blocks, count(*) FILTER (status = 'accepted') AS accepted,
      count(*) FILTER (status = 'weak') AS weak, count(*) FILTER (status = 'rejected') AS rejected, sum(score)::bigint AS score_sum FROM scored GROUP BY 1""", SCORED)),
    "a11_c04_parent_chunks": (parents, PARENTS_SQL),
    "c01_packed_chunks": (packed, PACKED_SQL),
    "c02_window_chunks": (windows, with_tables("SELECT file_md5, chunk_id, length(text_content) AS n_chars, md5(text_content) AS text_md5 FROM chunks")),
    "w01_j10_child_chunks": (children, CHILD_SQL),
    "r20_chunk_sources": (sources, SOURCES_SQL),
    "a21_parser_counts": (parser_use, with_tables("SELECT file_md5, parser AS source_parser, count(*) AS n FROM scored JOIN mult USING (file_md5, block_index) GROUP BY 1, 2", {
        **PACK_STEPS, "mult": "SELECT file_md5, block_index FROM body JOIN pack USING (file_md5, pos) JOIN rows_ r USING (file_md5, start)"})),
    "a13_block_routing": (routing, ROUTING_SQL),
    "c05_table_rows": (rows_from_blocks, with_tables("SELECT file_md5, sheet, row_no::int AS row_no, p_name AS name, 4 AS n_fields, 'xlsx' AS source_parser FROM part_blocks")),
    "p14_relation_gate": (gate, GATE_SQL),
    "w07_page_routing": (page_routing, PAGE_SQL),
    "w11_sections": (sections, with_tables("""SELECT file_md5, block_index AS position, coalesce(last_value(CASE WHEN length(text) < 60 THEN text END IGNORE NULLS)
      OVER (PARTITION BY file_md5 ORDER BY block_index), '') AS section FROM blocks""")),
    "u04_c08_distinct_units": (distinct_units, with_tables("SELECT DISTINCT file_md5, unit_key AS document_unit_key FROM scored", SCORED)),
}
