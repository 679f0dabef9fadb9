"""Registered queries: sheets, schedules, page images and page analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import text as X
from marginalia.operators import analyses as A, blocks as B, pages as P, sheets as S
from marginalia.plans.joins import spread
from marginalia.plans.oracle import clean, has_any, with_tables
from marginalia.plans.tables import Tables
from marginalia.session import stored

KEY = ["file_md5", "sheet"]


def value_cells(t: Tables):
    """Parts laid out as sheets of 40 rows by 6 columns; a quarter of the cells is blank."""
    k = F.col("p_partkey").cast("long")
    v = (
        F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.col("p_size").cast("string"))
        .when(k % 4 == 2, F.concat(F.lit(" "), "p_brand")).otherwise(F.lit(None).cast("string"))
    )
    v = F.when((k % 40 == 2) & (k % 4 == 2), F.concat(F.lit("name "), "p_type")).otherwise(v)
    return t.raw("part").select(
        F.md5(F.floor(k / 240).cast("string")).alias("file_md5"), F.lit("S").alias("sheet"),
        (k % 40 + 1).cast("int").alias("row"), (F.floor(k / 40) % 6 + 1).cast("int").alias("col"), v.alias("value"),
    )


VC = {"vcells": """SELECT md5((p_partkey // 240)::varchar) AS file_md5, 'S' AS sheet, (p_partkey % 40 + 1)::int AS "row", (p_partkey // 40 % 6 + 1)::int AS col,
  CASE WHEN p_partkey % 40 = 2 THEN 'name ' || p_type WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_size::varchar WHEN p_partkey % 4 = 2 THEN p_brand ELSE '' END AS v FROM part""",
    "hd": f"""SELECT file_md5, sheet, "row", round(count(*) * 1.6::double + count(DISTINCT v) * 0.5::double + count(*) FILTER (regexp_matches(v, '[A-Za-z]')) * 1.2::double
      + count(*) FILTER ({has_any('lower(v)', C.HEADER_HINTS)}) * 2.0::double - count(*) FILTER (regexp_matches(v, '^[-+]?[0-9]+([.,][0-9]+)?$')) * 0.9::double, 6) AS s
      FROM vcells WHERE v <> '' AND "row" <= 25 GROUP BY ALL HAVING count(*) >= 2""",
    "hr": """SELECT file_md5, sheet, "row" AS header_row, s AS header_score FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet ORDER BY s DESC, "row") AS r FROM hd) WHERE r = 1""",
    "shp": """SELECT v.file_md5, v.sheet, max(col) AS width, coalesce(any_value(header_row), min("row") FILTER (v <> '')) AS header FROM vcells v LEFT JOIN hr USING (file_md5, sheet) GROUP BY 1, 2 HAVING count(*) FILTER (v <> '') > 0""",
    "lab": """SELECT file_md5, sheet, col, v AS label FROM vcells JOIN shp USING (file_md5, sheet) WHERE "row" = header AND v <> ''""",
}


def headers(t: Tables):
    return S.header_rows(value_cells(t))


def row_blocks(t: Tables):
    r = S.row_blocks(value_cells(t))
    return r.select(*KEY, "row_no", "type", "text", F.size("row_json").alias("n_fields"))


ROWS_SQL = with_tables("""SELECT file_md5, sheet, header AS row_no, 'table_header' AS type, string_agg(coalesce(label, 'col_' || i), ' | ' ORDER BY i) AS text, count(*) AS n_fields
  FROM (SELECT file_md5, sheet, header, unnest(range(1, width + 1)) AS i FROM shp) w LEFT JOIN lab l USING (file_md5, sheet) WHERE false GROUP BY ALL
  UNION ALL SELECT file_md5, sheet, header, 'table_header', string_agg(coalesce(label, 'col_' || i), ' | ' ORDER BY i), count(*)
  FROM (SELECT w.*, label FROM (SELECT file_md5, sheet, header, unnest(range(1, width + 1)) AS i FROM shp) w LEFT JOIN lab l ON l.file_md5 = w.file_md5 AND l.sheet = w.sheet AND l.col = w.i) GROUP BY 1, 2, 3
  UNION ALL SELECT v.file_md5, v.sheet, "row", 'table_row', string_agg(coalesce(label, 'col_' || v.col) || ': ' || v, ' ; ' ORDER BY v.col), count(DISTINCT coalesce(label, 'col_' || v.col))
  FROM vcells v JOIN shp ON shp.file_md5 = v.file_md5 AND shp.sheet = v.sheet LEFT JOIN lab l ON l.file_md5 = v.file_md5 AND l.sheet = v.sheet AND l.col = v.col
  WHERE "row" > header AND v <> '' GROUP BY 1, 2, 3""", VC)


def runs(t: Tables):
    return S.longest_runs(t.sheet_cells()).select(*KEY, "row", "fill_sig", "start_col", "end_col", "len")


RUN_STEPS = {
    "isl": """SELECT file_md5, sheet, "row", fill_sig, min(col) AS start_col, max(col) AS end_col, count(*) AS len FROM (
      SELECT *, col - row_number() OVER (PARTITION BY file_md5, sheet, "row", fill_sig ORDER BY col) AS g FROM runcells) GROUP BY file_md5, sheet, "row", fill_sig, g""",
    "bst": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet, "row" ORDER BY len DESC, seen, start_col) AS r FROM (
      SELECT *, min(start_col) OVER (PARTITION BY file_md5, sheet, "row", fill_sig) AS seen FROM isl)) WHERE r = 1""",
}


def gantt(t: Tables):
    """Customers as tasks, months as timeline columns from 3 on, order status and priority as fill."""
    k = F.col("o_custkey")
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    o = t.raw("orders").select(
        F.md5((k % 25).cast("string")).alias("file_md5"), F.concat(F.lit("g"), k % 25).alias("sheet"),
        (F.floor(k / 25) + 4).cast("int").alias("row"), (month + 2).cast("int").alias("col"),
        F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("fill_sig"),
    )
    body = o.groupBy(*KEY, "row", "col").agg(F.min("fill_sig").alias("fill_sig")).withColumn("value", F.lit(""))
    cols = o.select(*KEY, "col").distinct().withColumn("m", (F.col("col") - 3) % 12 + 1).withColumn("y", F.floor((F.col("col") - 3) / 12) + 1992)
    heads = F.array(
        F.struct(F.lit(1).alias("row"), F.when(F.col("m") == 1, F.col("y").cast("string")).alias("value")),
        F.struct(F.lit(2).alias("row"), F.col("m").cast("string").alias("value")),
        F.struct(F.lit(3).alias("row"), F.when(F.col("m") % 2 == 1, (F.col("col") % 4 + 1).cast("string")).alias("value")),
    )
    head = cols.select(*KEY, "col", F.explode(heads).alias("h")).select(*KEY, "h.row", "col", F.lit("").alias("fill_sig"), F.coalesce("h.value", F.lit("")).alias("value"))
    c = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    kk = F.col("c_custkey")
    names = F.array(F.struct(F.lit(1).alias("col"), F.col("c_name").alias("value")), F.struct(F.lit(2).alias("col"), F.when(kk % 3 != 0, F.col("c_mktsegment")).alias("value")))
    left = c.filter(kk % 10 != 7).select(
        F.md5((kk % 25).cast("string")).alias("file_md5"), F.concat(F.lit("g"), kk % 25).alias("sheet"), (F.floor(kk / 25) + 4).cast("int").alias("row"),
        F.explode(names).alias("n"),
    ).select(*KEY, "row", "n.col", F.lit("").alias("fill_sig"), F.coalesce("n.value", F.lit("")).alias("value"))
    cols_out = [*KEY, "row", "col", "value", "fill_sig"]
    return body.select(cols_out).unionByName(head.select(cols_out)).unionByName(left.select(cols_out))


GANTT = {
    "go": """SELECT md5((o_custkey % 25)::varchar) AS file_md5, 'g' || (o_custkey % 25) AS sheet, (o_custkey // 25 + 4)::int AS "row",
      ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) + 2)::int AS col, o_orderstatus || left(o_orderpriority, 1) AS fill_sig FROM orders""",
    "gb": """SELECT file_md5, sheet, "row", col, min(fill_sig) AS fill_sig FROM go GROUP BY ALL""",
    "gc": "SELECT DISTINCT file_md5, sheet, col, (col - 3) % 12 + 1 AS m, (col - 3) // 12 + 1992 AS y FROM go",
    "gl": """SELECT *, concat_ws('-', last_value(CASE WHEN m = 1 THEN y END IGNORE NULLS) OVER (PARTITION BY file_md5, sheet ORDER BY col), m || '月', CASE WHEN m % 2 = 1 THEN 'W' || (col % 4 + 1) END) AS label FROM gc""",
    "gt": """SELECT md5((c_custkey % 25)::varchar) AS file_md5, 'g' || (c_custkey % 25) AS sheet, (c_custkey // 25 + 4)::int AS "row", c_name AS task,
      CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS detail FROM customer WHERE c_custkey % 10 <> 7""",
    "gf": """SELECT file_md5, sheet, fill_sig, count(*) AS n, count(*)::double / (any_value(nr) * any_value(nc)) >= 0.12::double AS background
      FROM gb JOIN gt USING (file_md5, sheet, "row") JOIN (SELECT file_md5, sheet, count(*) AS nr FROM gt GROUP BY 1, 2) USING (file_md5, sheet)
      JOIN (SELECT file_md5, sheet, count(*) AS nc FROM gc GROUP BY 1, 2) USING (file_md5, sheet) GROUP BY 1, 2, 3""",
    "runcells": """SELECT file_md5, sheet, "row", col, fill_sig FROM gb JOIN gt USING (file_md5, sheet, "row") JOIN gf USING (file_md5, sheet, fill_sig) WHERE NOT background""",
    **RUN_STEPS,
    "gs": """SELECT b.*, task, detail, s.label AS start_label, e.label AS end_label, (CASE WHEN len >= 3 THEN 78 ELSE 60 END + 12 + CASE WHEN detail <> '' THEN 8 ELSE 0 END) / 100.0::double AS confidence
      FROM bst b JOIN gt USING (file_md5, sheet, "row") JOIN gl s ON s.file_md5 = b.file_md5 AND s.sheet = b.sheet AND s.col = start_col
      JOIN gl e ON e.file_md5 = b.file_md5 AND e.sheet = b.sheet AND e.col = end_col WHERE len >= 2""",
}


def timeline(t: Tables):
    c = gantt(t)
    return S.timeline_columns(c, S.timeline_rows(c)).select(*KEY, "col", "label", "n_cols", "first_col", "last_col")


def fills(t: Tables):
    c = gantt(t)
    r = S.timeline_rows(c)
    cols = S.timeline_columns(c, r)
    return S.background_fills(c, S._tasks(c, r, cols.select(*KEY, "first_col").distinct()), cols)


def schedule(t: Tables):
    return S.schedule_blocks(S.schedule_rows(stored(gantt(t), "cells"))).select(*KEY, "row_no", "text", F.size("row_json").alias("n_fields"))


def anchors(t: Tables):
    k = F.col("o_custkey")
    start = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")
    bars = t.raw("orders").select(
        F.md5((k % 25).cast("string")).alias("file_md5"), F.concat(F.lit("g"), k % 25).alias("sheet"), (F.floor(k / 25) + 4).cast("int").alias("row"),
        (start - 3).alias("start_col"), (start + F.col("o_orderkey").cast("int") % 9).alias("end_col"), F.col("o_orderkey").alias("anchor_no"),
    )
    return S.schedule_from_anchors(stored(gantt(t), "cells"), bars).select(*KEY, "row_no", "task", "start_col", "end_col", "start_label", "end_label")


ANCHOR_SQL = with_tables("""SELECT b.file_md5, b.sheet, b."row" AS row_no, task, a AS start_col, e AS end_col, coalesce(s.label, 'C' || a) AS start_label, coalesce(f.label, 'C' || e) AS end_label
  FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet, "row" ORDER BY e - a DESC, o_orderkey) AS r FROM ab WHERE e > a) b
  JOIN gt USING (file_md5, sheet, "row") LEFT JOIN gl s ON s.file_md5 = b.file_md5 AND s.sheet = b.sheet AND s.col = a LEFT JOIN gl f ON f.file_md5 = b.file_md5 AND f.sheet = b.sheet AND f.col = e WHERE r = 1""", {
    **{k: GANTT[k] for k in ("go", "gc", "gl", "gt")},
    "ab": """SELECT o.*, greatest(m - 3, lo) AS a, least(m + o_orderkey % 9, hi) AS e FROM (SELECT md5((o_custkey % 25)::varchar) AS file_md5, 'g' || (o_custkey % 25) AS sheet, (o_custkey // 25 + 4)::int AS "row",
      (year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS m, o_orderkey FROM orders) o JOIN (SELECT file_md5, sheet, min(col) AS lo, max(col) AS hi FROM gc GROUP BY 1, 2) USING (file_md5, sheet)
      WHERE m + o_orderkey % 9 >= lo AND m - 3 <= hi""",
})


def sheet_blocks(t: Tables):
    return t.part_blocks().withColumn("sheet", F.concat("sheet", F.lit("/"), (F.col("row_no") % 90).cast("string"))).withColumn(
        "type", F.when(F.col("row_no") % 3 == 0, "diagram_edge").when(F.col("row_no") % 3 == 1, "diagram_node").otherwise(F.col("type"))
    )


def sheet_stats(t: Tables):
    return S.sheet_statistics(sheet_blocks(t), {"node_threshold": 2})


SHEET_STATS_SQL = with_tables("""SELECT s.*, coalesce(distinct_tokens, 0) AS distinct_tokens, (edges >= 1 AND nodes >= 2) OR nodes >= 2 OR
    (cells >= 8 AND chars <= 320 AND tokens <= 120 AND chars::double / cells <= 8.0 AND coalesce(distinct_tokens, 0) <= 120 AND table_rows <= 2) AS candidate
  FROM (SELECT file_md5, sheet, count(*) FILTER (kind = 0) AS edges, count(*) FILTER (kind = 1) AS nodes, count(*) FILTER (kind = 2) AS table_rows,
    sum(length(text))::bigint AS chars, sum(len(w))::bigint AS tokens, count(*) * 5 AS cells FROM sb GROUP BY 1, 2) s
  LEFT JOIN (SELECT file_md5, sheet, count(DISTINCT lower(x)) AS distinct_tokens FROM (SELECT file_md5, sheet, unnest(w) AS x FROM sb) GROUP BY 1, 2) USING (file_md5, sheet)""", {
    "sb": "SELECT file_md5, sheet || '/' || (row_no % 90) AS sheet, row_no % 3 AS kind, text, regexp_extract_all(text, '[A-Za-z0-9]{2,24}') AS w FROM part_blocks"})


def page_match(t: Tables):
    """Orders as pages that mention part names; part names as sheet names of the file."""
    k = F.col("p_partkey")
    sheets = t.raw("part").select((k % 50).cast("string").alias("file_md5"), "p_name", "p_brand").groupBy("file_md5", F.col("p_name").alias("sheet")).agg(
        F.min("p_brand").alias("b")).withColumn("sheet_no", F.ascii("sheet") * 1000 + F.length("sheet"))
    toks = sheets.select("file_md5", "sheet", F.explode(F.array(X.sheet_match_key(F.col("sheet")), X.sheet_match_key(F.col("b")))).alias("token"))
    # lines are made distinct before they are collected: a page holds each once, however many orders name it
    lines = t.raw("lineitem").join(t.raw("part"), F.col("l_partkey") == k).select(
        (k % 50).cast("string").alias("file_md5"), (F.col("l_orderkey") % 40).cast("int").alias("page"), F.concat_ws(" - ", "p_name", "p_brand").alias("line")).distinct()
    pages = lines.groupBy("file_md5", "page").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    m = S.match_pages(pages, sheets, toks)
    return m.select("file_md5", "page", F.length("sheet").alias("n"), "n_named")


PAGE_MATCH = {
    "sh": "SELECT (p_partkey % 50)::varchar AS file_md5, p_name AS sheet, min(p_brand) AS b, ascii(p_name) * 1000 + length(p_name) AS sheet_no FROM part GROUP BY ALL",
    "pgs": """SELECT file_md5, page, array_to_string(list_sort(list(DISTINCT x)), chr(10)) AS text FROM (SELECT (p_partkey % 50)::varchar AS file_md5, (l_orderkey % 40)::int AS page,
      p_name || ' - ' || p_brand AS x FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
    "pk": "SELECT *, regexp_replace(lower(text), '[ _-]', '', 'g') AS k FROM pgs",
    "mt": """SELECT file_md5, page, sheet, sheet_no, contains(k, n)::int + CASE WHEN n <> bn THEN contains(k, bn)::int ELSE 0 END AS score FROM (SELECT *, regexp_replace(lower(sheet), '[ _-]', '', 'g') AS n, regexp_replace(lower(b), '[ _-]', '', 'g') AS bn FROM sh)
      JOIN pk USING (file_md5) WHERE contains(k, n)""",
}


def backfill(t: Tables):
    p = t.blocks().select("file_md5", (F.col("block_index") + 1).alias("page"), F.when((F.col("doc_id") + F.col("block_index")) % 3 != 1, F.concat(F.lit("s"), F.floor(F.col("block_index") / 7))).alias("sheet"))
    p = p.withColumn("mode", F.when(F.col("sheet").isNotNull(), "text_strict").otherwise("none")).withColumn("confidence", F.when(F.col("sheet").isNotNull(), 1.0).otherwise(0.0))
    return S.backfill_pages(p)


BACKFILL = {
    "bp": "SELECT file_md5, block_index + 1 AS page, CASE WHEN (doc_id + block_index) % 3 <> 1 THEN 's' || (block_index // 7) END AS sheet FROM blocks",
    "bq": "SELECT *, lag(sheet) OVER w AS p, lead(sheet) OVER w AS n FROM bp WINDOW w AS (PARTITION BY file_md5 ORDER BY page)",
    "bf": """SELECT file_md5, page, coalesce(sheet, CASE WHEN p = n THEN p END) AS sheet, CASE WHEN sheet IS NOT NULL THEN 'text_strict' WHEN p = n THEN 'neighbor_window' ELSE 'unbound' END AS mode,
      CASE WHEN sheet IS NOT NULL THEN 1.0 WHEN p = n THEN 0.45 ELSE 0 END::double AS confidence FROM bq""",
}


def per_sheet(t: Tables):
    return S.pages_per_sheet(backfill(t)).select("file_md5", "sheet", "page", "nth")


def drawing(t: Tables):
    k = F.col("p_partkey").cast("int")
    nodes = t.raw("part").select(
        F.concat(F.lit("f"), k % 5).alias("file_md5"), F.concat(F.lit("s"), F.floor(k / 5) % 4).alias("sheet"), k.alias("node_no"),
        F.concat("p_name", F.lit(" "), F.floor(k / 400)).alias("name"), (F.col("p_size") * 8.0).alias("x"), (k * 37 % 400).cast("double").alias("y"),
    )
    o = F.col("o_orderkey").cast("int")
    conn = t.raw("orders").select(
        F.concat(F.lit("f"), o % 5).alias("file_md5"), F.concat(F.lit("s"), F.floor(o / 5) % 4).alias("sheet"), o.alias("conn_no"),
        (F.col("o_custkey") % 400).alias("x1"), (o * 13 % 400).alias("y1"), (o * 7 % 400).alias("x2"), (F.col("o_custkey") * 11 % 400).alias("y2"),
    )
    return S.drawing_edges(nodes, conn)


DRAW = {
    "dn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet, regexp_replace(lower(name), '\\s+', '', 'g') ORDER BY node_no) AS r FROM (
      SELECT 'f' || (p_partkey % 5) AS file_md5, 's' || (p_partkey // 5 % 4) AS sheet, p_partkey AS node_no, p_name || ' ' || (p_partkey // 400) AS name, p_size * 8.0::double AS x, (p_partkey * 37 % 400)::double AS y FROM part)) WHERE r = 1""",
    "dc": """SELECT 'f' || (o_orderkey % 5) AS file_md5, 's' || (o_orderkey // 5 % 4) AS sheet, o_orderkey AS conn_no, o_custkey % 400 AS x1, o_orderkey * 13 % 400 AS y1, o_orderkey * 7 % 400 AS x2, o_custkey * 11 % 400 AS y2 FROM orders""",
    "de": "SELECT file_md5, sheet, conn_no, 0 AS side, x1 AS ex, y1 AS ey FROM dc UNION ALL SELECT file_md5, sheet, conn_no, 1, x2, y2 FROM dc",
    "dd": "SELECT e.*, name, node_no, sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) AS d FROM de e JOIN dn USING (file_md5, sheet)",
    "db": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet, conn_no, side ORDER BY d, node_no) AS r FROM dd) WHERE r = 1 AND d <= 25",
    "dp": "SELECT a.file_md5, a.sheet, a.conn_no, a.name AS src, b.name AS dst, round_even(greatest(0.4::double, least(0.95::double, 1 - (a.d + b.d) / 80)), 2) AS confidence FROM db a JOIN db b ON a.conn_no = b.conn_no AND a.side = 0 AND b.side = 1 WHERE a.name <> b.name",
}


def media(t: Tables):
    k = F.col("p_partkey")
    img = t.raw("part").select(
        F.md5((k % 60).cast("string")).alias("file_md5"), F.concat(F.lit("media/"), F.col("p_name"), k, F.when(k % 9 == 0, ".gif").otherwise(".PNG")).alias("name"),
        (F.col("p_size") * 40).alias("width"), (k % 900).alias("height"), F.when(k % 11 == 0, "tiff").otherwise("png").alias("format"),
    )
    return S.media_candidates(img, 8).select("file_md5", "name", "width", "height", "nth")


def page_units(t: Tables):
    v = t.visual_pages()
    kinds = F.array(F.lit("pdf_page_render"), F.lit("ocr"), F.lit("xlsx_sheet_snapshot"))
    rec = v.select(
        F.md5((F.col("visual_page_id") % 50).cast("string")).alias("file_md5"), F.col("visual_page_id").alias("record_no"),
        F.concat(F.lit("img/"), (F.col("visual_page_id") % 170).cast("string")).alias("storage_path"),
        F.element_at(kinds, (F.col("visual_page_id") % 3 + 1).cast("int")).alias("source_parser"),
        F.when(F.col("visual_page_id") % 2 == 0, "xlsx").otherwise("pdf").alias("file_type"),
        F.when(F.col("visual_page_id") % 4 == 0, F.col("sheet")).alias("sheet"), F.lit(None).cast("string").alias("section"),
        F.when(F.col("visual_page_id") % 5 != 0, (F.col("visual_page_id") % 40 + 1).cast("int")).alias("page"),
    )
    units = t.raw("supplier").select(
        F.md5((F.col("s_suppkey") % 50).cast("string")).alias("file_md5"), F.concat(F.lit("page:"), F.col("s_suppkey") % 40 + 1).alias("unit_key"),
        F.col("s_suppkey").alias("unit_id"),
    ).dropDuplicates(["file_md5", "unit_key"])
    r = S.visual_page_rows(rec, units)
    return r.select("file_md5", "image_path", "unit_key", "page_label", F.col("document_unit_id").isNotNull().alias("linked"))


PAGE_UNITS = {
    "vr": """SELECT md5((vec_id % 50)::varchar) AS file_md5, vec_id AS no, 'img/' || (vec_id % 170) AS image_path, vec_id % 2 = 0 AS xl, CASE WHEN vec_id % 4 = 0 THEN 'sheet_' || label END AS sh,
      CASE WHEN vec_id % 5 <> 0 THEN vec_id % 40 + 1 END AS page FROM embeddings WHERE vec_id % 3 <> 1""",
    "vf": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, image_path ORDER BY no) AS r FROM vr) WHERE r = 1",
    "vu": """SELECT *, CASE WHEN xl AND sh IS NOT NULL THEN 'sheet:' || sh WHEN page IS NOT NULL THEN 'page:' || page WHEN xl THEN 'sheet:workbook' ELSE 'document:root' END AS unit_key FROM vf""",
}


def latest(t: Tables):
    e = t.raw("events").select((F.col("event_id") % 400).alias("visual_page_id"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_name"))
    pages = t.visual_pages().select("visual_page_id", "page_label")
    return pages.join(P.latest_embedding(e), "visual_page_id", "left").select(
        "visual_page_id", "page_label", F.coalesce("embedding_id", F.lit(-1)).alias("embedding_id"), F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("model_name", F.lit("-")).alias("model_name"))


def best_parents(t: Tables):
    p = t.raw("part").select(
        F.md5((F.col("p_partkey") % 50).cast("string")).alias("file_md5"), F.concat(F.lit("page:"), F.col("p_partkey") % 7).alias("document_unit_key"), F.col("p_partkey").alias("parent_chunk_id"),
        F.col("p_size").alias("quality_score"), F.when(F.col("p_size") % 4 == 0, "rejected").otherwise("weak").alias("quality_status"), F.col("p_name").alias("text_content"))
    return P.best_parent(p)


def payloads(t: Tables):
    """One analysis per part, in the new or the old field names."""
    k = F.col("p_partkey")
    js = F.to_json(F.struct(
        F.when(k % 2 == 0, F.col("p_name")).alias("page_name"), F.when(k % 2 == 1, F.concat(F.lit("View "), "p_brand")).alias("view_name"),
        F.when(k % 3 == 0, F.col("p_type")).alias("page_id"), F.when(k % 5 != 0, F.lit("flow")).alias("diagram_type"),
        F.when(k % 7 != 0, F.col("p_name")).alias("diagram_overview"),
        F.when(k % 4 != 3, F.array("p_brand", F.concat(F.lit(" "), F.upper("p_brand")), "p_type", F.lit(""))).alias("components"),
        F.when(k % 4 != 3, F.array(F.concat_ws(" -> ", "p_brand", "p_name"), F.lit("no arrow"))).alias("relationships"),
        F.when(k % 6 != 0, (F.col("p_size") / 40).cast("string")).otherwise("high").alias("confidence"),
        F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.lower("p_type").alias("name"))).alias("nodes"),
        F.array(F.struct(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("输入").alias("relation_type"), F.lit("0.9").alias("confidence")),
                F.struct(F.col("p_type").alias("src"), F.col("p_type").alias("dst"), F.lit("").alias("relation_type"), F.lit("x").alias("confidence"))).alias("edges"),
    ))
    return spread(t.raw("part")).select(
        F.md5(k.cast("string")).alias("file_md5"), F.when(k % 8 != 0, F.concat(F.lit("img/"), k)).alias("image_path"), js.alias("payload_json"))


def analysed(t: Tables):
    return A.score(A.projection(A.normalise(payloads(t))))


def scores(t: Tables):
    return analysed(t).select(
        "file_md5", "page_id", "page_name", "diagram_type", F.array_join("nodes", ",").alias("nodes"), F.size("edges").alias("n_edges"),
        "quality_score", "quality_status", F.array_join("validation_flags", ",").alias("flags"))


ANALYSIS = {
    "ap": """SELECT *, p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'View ' || p_brand END AS page_name FROM part""",
    "an": f"""SELECT *, CASE WHEN k % 3 = 0 THEN p_type ELSE regexp_replace(regexp_replace(lower(page_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS page_id,
      CASE WHEN k % 4 <> 3 THEN [p_brand, p_type, p_name] ELSE [p_name, lower(p_type)] END AS nodes,
      CASE WHEN k % 4 <> 3 THEN 2 ELSE 1 END AS n_edges,
      CASE WHEN k % 6 <> 0 THEN least(p_size / 40.0::double, 1.0::double) ELSE 0.65::double END AS conf, k % 8 <> 0 AS img FROM ap""",
    "asx": """SELECT *, least(100, CASE WHEN img THEN 25 ELSE 0 END + 40 + least(20, 5 + len(nodes)) + least(15, 5 + 2 * n_edges) + round_even(conf * 20, 0)::int) AS score FROM an""",
}


def analysis_blocks(t: Tables):
    b = A.to_blocks(analysed(t))
    return b.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("file_md5").alias("n_files"))


def linked(t: Tables):
    pages = t.visual_pages().select(F.md5(F.col("visual_page_id").cast("string")).alias("file_md5"), F.concat(F.lit("img/"), F.col("visual_page_id")).alias("image_path"), "visual_page_id")
    found, skipped = S.link_analyses(payloads(t).filter("image_path is not null"), pages)
    row = lambda df, page, outcome: df.select("file_md5", "image_path", page.alias("visual_page_id"), F.lit(outcome).alias("outcome"))
    return row(found, F.col("visual_page_id").cast("long"), "persisted").unionByName(row(skipped, F.lit(-1).cast("long"), "skipped"))


def graphs(t: Tables):
    b = sheet_blocks(t).withColumn("source_parser", F.lit("xlsx_diagram"))
    row = F.create_map(F.lit("src"), F.col("row_json")["brand"], F.lit("dst"), F.col("row_json")["type"], F.lit("name"), F.col("row_json")["name"])
    b = b.withColumn("row_json", row)
    return S.diagram_graphs(b).select(*KEY, "kind", "name", F.coalesce("dst", F.lit("-")).alias("dst"))


QUERIES = {
    "a14_s13_header_rows": (headers, with_tables("SELECT * FROM hr", {k: VC[k] for k in ("vcells", "hd", "hr")})),
    "c06_row_blocks": (row_blocks, ROWS_SQL),
    "w05_longest_runs": (runs, with_tables('SELECT file_md5, sheet, "row", fill_sig, start_col, end_col, len FROM bst', {"runcells": "SELECT * FROM sheet_cells", **RUN_STEPS})),
    "a15_w04_timeline": (timeline, with_tables("SELECT file_md5, sheet, col, label, count(*) OVER p AS n_cols, min(col) OVER p AS first_col, max(col) OVER p AS last_col FROM gl WINDOW p AS (PARTITION BY file_md5, sheet)", {k: GANTT[k] for k in ("go", "gc", "gl")})),
    "a16_background_fills": (fills, with_tables("SELECT * FROM gf", {k: GANTT[k] for k in ("go", "gb", "gc", "gt", "gf")})),
    "c07_w05_schedule_blocks": (schedule, with_tables("""SELECT file_md5, sheet, "row" AS row_no, '[schedule] sheet=' || sheet || ' ; task=' || task || ' ; period=' || start_label || ' -> ' || end_label
      || CASE WHEN detail <> '' THEN ' ; detail=' || detail ELSE '' END || ' ; confidence=' || printf('%.2f', confidence) AS text, 7 AS n_fields FROM gs""", GANTT)),
    "w06_schedule_from_anchors": (anchors, ANCHOR_SQL),
    "a12_sheet_statistics": (sheet_stats, SHEET_STATS_SQL),
    "j14_page_sheet_match": (page_match, with_tables("""SELECT file_md5, page, length(sheet) AS n, n_named FROM (SELECT *, count(*) OVER (PARTITION BY file_md5, page) AS n_named,
      row_number() OVER (PARTITION BY file_md5, page ORDER BY score DESC, sheet_no) AS r FROM mt) WHERE r = 1""", PAGE_MATCH)),
    "w08_page_backfill": (backfill, with_tables("SELECT * FROM bf", BACKFILL)),
    "w09_pages_per_sheet": (per_sheet, with_tables("""SELECT file_md5, sheet, page, nth FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, sheet ORDER BY page) AS nth FROM bf
      WHERE sheet IS NOT NULL) WHERE nth <= 3""", BACKFILL)),
    "j15_drawing_edges": (drawing, with_tables("SELECT file_md5, sheet, src, dst, arg_min(confidence, conn_no) AS confidence, '连接' AS relation_type FROM dp GROUP BY 1, 2, 3, 4", DRAW)),
    "p17_media_candidates": (media, """SELECT file_md5, name, width, height, nth FROM (SELECT *, row_number() OVER (PARTITION BY file_md5 ORDER BY name) AS nth FROM (
      SELECT md5((p_partkey % 60)::varchar) AS file_md5, 'media/' || p_name || p_partkey || '.PNG' AS name, p_size * 40 AS width, p_partkey % 900 AS height, p_partkey % 11 = 0 AS bad
      FROM part WHERE p_partkey % 9 <> 0)) WHERE nth <= 8 AND width * height >= 120000 AND least(width, height) >= 220 AND NOT bad"""),
    "j09_visual_page_rows": (page_units, with_tables("""SELECT v.file_md5, image_path, unit_key, coalesce('sheet:' || sh, 'page:' || page, unit_key) AS page_label,
      EXISTS (SELECT 1 FROM supplier s WHERE md5((s_suppkey % 50)::varchar) = v.file_md5 AND 'page:' || (s_suppkey % 40 + 1) = v.unit_key) AS linked FROM vu v""", PAGE_UNITS)),
    "j08_latest_embedding": (latest, """SELECT vec_id AS visual_page_id, 'page:' || (vec_id % 40 + 1) AS page_label, coalesce(event_id, -1) AS embedding_id, coalesce(event_type, '-') AS status, coalesce('m' || (user_id % 5), '-') AS model_name
      FROM embeddings LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY event_id % 400 ORDER BY event_id DESC) AS r FROM events) e ON e.event_id % 400 = vec_id AND r = 1"""),
    "j05_best_parents": (best_parents, """SELECT file_md5, document_unit_key, text_content, parent_chunk_id FROM (SELECT md5((p_partkey % 50)::varchar) AS file_md5, 'page:' || (p_partkey % 7) AS document_unit_key,
      p_name AS text_content, p_partkey AS parent_chunk_id, row_number() OVER (PARTITION BY p_partkey % 50, p_partkey % 7 ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_size % 4 <> 0) WHERE r = 1"""),
    "c10_f12_page_analyses": (scores, with_tables("""SELECT md5(k::varchar) AS file_md5, page_id, page_name, CASE WHEN k % 5 <> 0 THEN 'flow' ELSE 'unknown' END AS diagram_type, array_to_string(nodes, ',') AS nodes, n_edges,
      score AS quality_score, CASE WHEN NOT img OR score < 60 THEN 'rejected' WHEN score >= 80 THEN 'accepted' ELSE 'weak' END AS quality_status, CASE WHEN img THEN '' ELSE 'missing_image_path' END AS flags FROM asx""", ANALYSIS)),
    "c11_f31_analysis_blocks": (analysis_blocks, with_tables("""SELECT 'diagram_page' AS type, count(*) AS n, count(*) AS n_files FROM asx UNION ALL SELECT 'diagram_summary', count(*), count(*) FROM asx
      UNION ALL SELECT 'diagram_projection', count(*), count(*) FROM asx WHERE img AND score >= 60 UNION ALL SELECT 'diagram_node', sum(len(nodes))::bigint, count(*) FROM asx
      UNION ALL SELECT 'diagram_edge', sum(n_edges)::bigint, count(*) FROM asx""", ANALYSIS)),
    "j07_link_analyses": (linked, """SELECT md5(p_partkey::varchar) AS file_md5, 'img/' || p_partkey AS image_path, coalesce(vec_id, -1)::bigint AS visual_page_id, CASE WHEN vec_id IS NULL THEN 'skipped' ELSE 'persisted' END AS outcome
      FROM part LEFT JOIN embeddings ON vec_id = p_partkey WHERE p_partkey % 8 <> 0"""),
    "g14_diagram_graphs": (graphs, with_tables("""SELECT file_md5, sheet || '/' || (row_no % 90) AS sheet, 'node' AS kind, arg_min(p_name, row_no) AS name, '-' AS dst FROM part_blocks WHERE row_no % 3 = 1 GROUP BY file_md5, sheet, row_no % 90, lower(replace(p_name, ' ', ''))
      UNION ALL SELECT file_md5, sheet || '/' || (row_no % 90), 'edge', p_brand, p_type FROM part_blocks WHERE row_no % 3 = 0""")),
}
