"""Registered queries: text and scalar functions (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.functions import text as X
from marginalia.functions.unicode import sheet_name_key
from marginalia.plans.joins import spread
from marginalia.plans.oracle import clean, has_any, lit, node_key, rr, sql_list, strip, with_tables
from marginalia.plans.tables import Tables

MD = """'# ' || substr(text, 1, 40) || chr(10) || '- **' || substr(text, 41, 20) || '** and `code` [link](x) *it*'
  || chr(10) || text"""


def clean_text(t: Tables):
    c = X.clean_text(F.col("text"))
    return t.raw("documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).alias("clean_len"))


def clean_preview(t: Tables):
    noisy = F.concat_ws(
        "", F.lit("col_"), F.col("p_size"), F.lit(": | "), F.col("p_name"), F.lit(" ;; "),
        F.col("p_brand"), F.lit(" | | col_2 : "), F.col("p_type"), F.lit(" ; "),
    )
    kind = F.when(F.col("p_size") % 3 == 0, "text").otherwise("table_row")
    parts = spread(t.raw("part")).select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), X.clean_preview(noisy, kind).alias("preview")
    )
    lines = t.blocks().select(
        F.concat_ws("_", F.lit("b"), "doc_id", "block_index").alias("id"),
        F.md5(X.clean_preview(F.col("text"), F.lit("pdf_table_row"))).alias("preview"),
    )
    return parts.unionByName(lines)


def preview_sql(expr: str) -> str:
    e = clean(expr)
    for pattern, by in (
        (r"(?:(?:^|\||;)\s*col_\d+\s*:?\s*)", " | "), (r"\|\s*\|+", "|"), (r";\s*;+", ";"),
        (r"(?:\s*\|\s*){2,}", " | "), (r"(?:\s*;\s*){2,}", " ; "),
        (r"^\s*[\|;:\-]+\s*|\s*[\|;:\-]+\s*$", ""),
    ):
        e = rr(e, pattern, by)
    return clean(e)


_NOISY = "'col_' || p_size || ': | ' || p_name || ' ;; ' || p_brand || ' | | col_2 : ' || p_type || ' ; '"
CLEAN_PREVIEW_SQL = with_tables(f"""
SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN {clean(_NOISY)} ELSE {preview_sql(_NOISY)} END AS preview
FROM part UNION ALL
SELECT 'b_' || doc_id || '_' || block_index, md5(CASE WHEN regexp_matches(p, '[A-Za-z0-9]') THEN p ELSE '' END)
FROM (SELECT doc_id, block_index, {preview_sql('text')} AS p FROM blocks)""")


def truncate(t: Tables):
    c = F.col("text")
    return t.raw("documents").select(
        "doc_id", X.short_text(c).alias("short"), F.md5(X.trim_preview(c)).alias("preview_md5"),
        F.md5(X.safe_text(c, 2000)).alias("safe_md5"),
    )


TRUNCATE_SQL = f"""SELECT doc_id,
  CASE WHEN length(c) <= 160 THEN c ELSE left(c, 160) || '...(len=' || length(c) || ')' END AS short,
  md5(CASE WHEN length(w) <= 240 THEN w ELSE left(w, 240) || '...' END) AS preview_md5,
  md5(left(s, 2000)) AS safe_md5
FROM (SELECT doc_id, {clean('text')} AS c, {strip(rr('text', chr(92) + 's+', ' '))} AS w, {strip('text')} AS s FROM documents)"""


def markdown(t: Tables):
    return t.raw("documents").select("doc_id", F.md5(X.clean_markdown(F.expr(MD.replace("chr(10)", "'\\n'")))).alias("plain_md5"))


def _markdown_sql(e: str) -> str:
    for pattern, by in (
        (r"(?m)^#+\s+", ""), (r"(?m)^[-*+]\s+", ""), (r"(?s)```[^`]*```", ""), (r"`[^`]+`", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"\*\*([^\*]+)\*\*", r"\1"), (r"\*([^\*]+)\*", r"\1"),
    ):
        e = rr(e, pattern, by)
    return clean(e)


def keys(t: Tables):
    names = (
        t.raw("customer").select(F.col("c_name").alias("name"))
        .unionByName(t.raw("part").select(F.concat_ws(" - ", "p_name", "p_brand", "p_type").alias("name")))
        .unionByName(t.raw("nation").select(F.concat_ws("|", "n_name", F.lit("x_y")).alias("name")))
    )
    n = F.col("name")
    return names.select(
        n, X.node_key(n).alias("node_key"), X.match_key(n).alias("match_key"), X.sheet_match_key(n).alias("sheet_key")
    )


KEYS_SQL = f"""SELECT name, {node_key('name')} AS node_key, {rr('lower(name)', '[' + chr(92) + 's_|-]+')} AS match_key,
  {rr(f"lower({clean('name')})", '[ _-]')} AS sheet_key
FROM (SELECT c_name AS name FROM customer UNION ALL
  SELECT p_name || ' - ' || p_brand || ' - ' || p_type FROM part UNION ALL SELECT n_name || '|x_y' FROM nation)"""


def page_ids(t: Tables):
    hint = F.when(F.col("p_size") % 5 == 0, F.col("p_type"))
    name = F.when(F.col("p_size") == 7, "").otherwise(F.concat_ws("##", "p_name", "p_brand"))
    return t.raw("part").select("p_partkey", X.fallback_page_id(name, hint).alias("page_id"))


PAGE_IDS_SQL = f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_type WHEN p_size = 7 THEN 'unknown_page'
  ELSE left({rr(rr("lower(p_name || '##' || p_brand)", '[^a-z0-9]+', '_'), '^_+|_+$')}, 80) END AS page_id FROM part"""


def confidence(t: Tables):
    raw = F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise((F.col("value") / 50 - 0.1).cast("string"))
    conf = X.confidence(raw, 0.65)
    tier = X.quality_tier((conf * 100).cast("int"))
    return t.raw("events").select("event_id", F.round(conf, 6).alias("confidence"), tier.alias("tier"))


CONFIDENCE_SQL = """SELECT event_id, round(c, 6) AS confidence,
  CASE WHEN trunc(c * 100) >= 80 THEN 'accepted' WHEN trunc(c * 100) >= 60 THEN 'weak' ELSE 'rejected' END AS tier
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.65::double
  ELSE least(greatest(value / 50 - 0.1::double, 0.0::double), 1.0::double) END AS c FROM events)"""


def page_quality(t: Tables):
    q = X.page_text_quality(X.clean_text(F.col("text")))
    return t.blocks().select("doc_id", "block_index", q.alias("q")).select(
        "doc_id", "block_index", "q.chars", "q.words", F.round("q.valid_ratio", 6).alias("valid_ratio")
    )


PAGE_QUALITY_SQL = with_tables(f"""SELECT doc_id, block_index, length(c) AS chars, len(w) AS words,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]')))::double / len(w), 6) ELSE 0 END AS valid_ratio
FROM (SELECT doc_id, block_index, c, regexp_extract_all(c, '[A-Za-z0-9]{{2,}}') AS w
  FROM (SELECT doc_id, block_index, {clean('text')} AS c FROM blocks))""")


def periods(t: Tables):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    start = F.concat(y, F.lit("年"), m, F.lit("月"))
    end = F.concat(y + F.col("o_orderkey").cast("int") % 3, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(start, F.lit(" -> "), end)).when(k == 1, F.concat(start, F.lit("～"), end))
        .when(k == 2, start).otherwise(F.concat(F.lit(" W"), m, F.lit(" ~ W"), m + 1))
    )
    p = X.period_labels(text)
    end_ym = X.ym(y, m + 2)
    as_of = F.lit("1998-06-15").cast("timestamp_ntz")
    return t.raw("orders").select("o_orderkey", p.alias("p"), end_ym.alias("end_ym")).select(
        "o_orderkey", F.col("p.start").alias("start_label"), F.col("p.end").alias("end_label"),
        X.period_duration(F.col("p.start"), F.col("p.end")).alias("duration"), "end_ym",
        X.months_since(F.col("end_ym"), as_of).alias("months_ago"),
    )


PERIODS_SQL = """WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m,
  y || '年' || m || '月' AS s, (y + o_orderkey % 3) || '-' || lpad(m::varchar, 2, '0') AS e FROM orders),
p AS (SELECT o_orderkey, y, m, CASE WHEN k IN (0, 1, 2) THEN s ELSE 'W' || m END AS a,
  CASE WHEN k IN (0, 1) THEN e WHEN k = 2 THEN s ELSE 'W' || (m + 1) END AS b, k, o_orderkey % 3 AS gap,
  y * 100 + least(m + 2, 12) AS end_ym FROM d)
SELECT o_orderkey, a AS start_label, b AS end_label,
  CASE WHEN k IN (0, 1) THEN (gap * 12 + 1) || 'か月' WHEN k = 2 THEN '1か月' ELSE a || ' ～ ' || b END AS duration,
  end_ym, greatest(0, 1998 * 12 + 6 - (end_ym // 100 * 12 + end_ym % 100)) AS months_ago FROM p"""


def pair_maps(t: Tables):
    m = X.pairs_to_map(F.col("text"))
    return t.part_blocks().select("row_no", m.alias("m")).select(
        "row_no", F.size("m").alias("n_keys"), F.col("m")["brand"].alias("brand"), F.col("m")["type"].alias("type"),
        F.col("m")["size"].alias("size"), F.col("m")["name"].alias("name"),
    )


PAIR_MAPS_SQL = """SELECT p_partkey AS row_no, 4 AS n_keys, p_brand AS brand, p_type AS type,
  p_size::varchar AS size, p_name AS name FROM part"""


def lists(t: Tables):
    lines = X.clean_list(F.split("text", "\n"), 50)
    tags = X.comma_list(F.concat_ws(",", F.lit(" a"), "role", F.lit(" ")))
    return t.raw("conversations").select(
        "conv_id", "turn", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "~")).alias("lines_md5"),
        F.array_join(tags, ",").alias("tags"),
    )


LISTS_SQL = f"""WITH l AS (SELECT conv_id, turn, role, unnest(list_slice(string_split(text, chr(10)), 1, 50)) AS x,
  unnest(range(least(50, len(string_split(text, chr(10)))))) AS i FROM conversations),
k AS (SELECT *, {clean('x')} AS c, {node_key(clean('x'))} AS key FROM l),
f AS (SELECT conv_id, turn, arg_min(c, i) AS c, min(i) AS i FROM k WHERE key <> '' GROUP BY conv_id, turn, key),
g AS (SELECT conv_id, turn, count(*) AS n, string_agg(c, '~' ORDER BY i) AS s FROM f GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(n, 0) AS n_lines, md5(coalesce(s, '')) AS lines_md5, 'a,' || role AS tags
FROM conversations LEFT JOIN g USING (conv_id, turn)"""


def labels(t: Tables):
    kinds = ["page", "component", "flow_node", "task", "Entity", "other"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.length("src") % 6 + 1).cast("int"))
    return t.relation_edges().select(
        "file_md5", X.edge_key(F.col("src"), F.col("relation_type"), F.col("dst")).alias("edge_key"),
        X.graph_label(kind, C.NODE_LABELS, "Entity", True).alias("node_label"),
        X.graph_label(F.col("relation_type"), C.EDGE_LABELS, "FLOWS_TO", False).alias("edge_label"),
        X.doc_key(F.col("file_md5"), F.col("page")).alias("doc_key"),
    )


LABELS_SQL = with_tables("""SELECT file_md5, edge_id AS edge_key,
  ['Page','Component','FlowNode','Task','Entity','Entity'][length(src) % 6 + 1] AS node_label,
  CASE relation_type WHEN '依赖' THEN 'DEPENDS_ON' WHEN '连接' THEN 'FLOWS_TO' WHEN '输出' THEN 'BELONGS_TO' END AS edge_label,
  file_md5 || '_' || page AS doc_key FROM relation_edges""")


def snapshot(t: Tables):
    def src(i):
        return F.struct(
            F.concat(F.lit("f"), F.col("c_custkey") + i).alias("file_name"), F.md5(F.col("c_name")).alias("file_md5"),
            (F.col("c_custkey") * i).alias("chunk_id"), F.lit(None).cast("int").alias("page"),
            F.col("c_mktsegment").alias("sheet"), (F.col("c_custkey") % 8 / 8).alias("score"), F.lit("x").alias("extra"),
        )

    arr = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 14).cast("int")), src)
    return t.raw("customer").select("c_custkey", F.md5(X.source_snapshot(arr)).alias("snapshot_md5"))


SNAPSHOT_SQL = """SELECT c_custkey, md5(to_json(list_transform(range(0, least(c_custkey % 14, 9) + 1), lambda i: struct_pack(
  file_name := 'f' || (c_custkey + i), file_md5 := md5(c_name), chunk_id := c_custkey * i, page := NULL::int,
  sheet := c_mktsegment, score := (c_custkey % 8) / 8.0::double)))::varchar) AS snapshot_md5 FROM customer"""


def masks(t: Tables):
    v = F.when(F.col("c_custkey") % 50 == 0, "").when(F.col("c_custkey") % 7 == 0, F.left("c_name", F.lit(3))).otherwise(F.col("c_name"))
    return t.raw("customer").select("c_custkey", X.mask(v).alias("masked"))


MASKS_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '****' WHEN c_custkey % 7 = 0 THEN '***'
  ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS masked FROM customer"""


def line_types(t: Tables):
    line = F.col("text")
    return t.blocks().select(
        "doc_id", "block_index", F.coalesce(Q.relation_type(line), F.lit("-")).alias("relation_type"),
        Q.likely_node(line).alias("likely_node"),
    )


def relation_type_sql(e: str) -> str:
    groups = " ".join(f"WHEN {has_any(e, w)} THEN {lit(n)}" for n, w in C.RELATION_KEYWORDS.items())
    return f"CASE {groups} WHEN {has_any(e, C.ARROWS)} THEN {lit(C.CONNECT)} END"


LINE_TYPES_SQL = with_tables(f"""SELECT doc_id, block_index, coalesce({relation_type_sql('lower(text)')}, '-') AS relation_type,
  coalesce(length(c) BETWEEN 2 AND 80 AND NOT regexp_matches(c, '^[0-9]+$') AND NOT {has_any('lower(c)', ['http://', 'https://', 'www.'])}
  AND regexp_matches(c, '[A-Za-z]') AND {relation_type_sql('lower(c)')} IS NULL, false) AS likely_node
FROM (SELECT doc_id, block_index, text,
  {rr(strip(rr('text', chr(92) + 's+', ' ')), r'^[\[\]()]+|[\[\]()]+$')} AS c FROM blocks)""")


def citation_rows(t: Tables):
    def mark(i, key):
        return F.concat(
            F.lit(f"[[SRC|{i}|doc"), F.col(key), F.lit("|"), F.md5(F.col(key).cast("string")), F.lit("|"),
            F.col("l_linenumber"), F.lit("||sheet"), F.col("l_returnflag"), F.lit("]]"),
        )

    answer = F.concat(
        F.lit("answer\n"), mark(1, "l_partkey"), F.lit("\n"), mark(2, "l_suppkey"), F.lit(" again "), mark(3, "l_partkey")
    )
    c = t.raw("lineitem").select("l_orderkey", F.explode(X.citations(answer)).alias("c"))
    return c.groupBy("c.index", "c.file_name", "c.file_md5", "c.sheet").agg(F.count("*").alias("n"))


CITATIONS_SQL = """SELECT index, file_name, file_md5, sheet, count(*) AS n FROM (
  SELECT '1' AS index, 'doc' || l_partkey AS file_name, md5(l_partkey::varchar) AS file_md5, 'sheet' || l_returnflag AS sheet FROM lineitem
  UNION ALL SELECT '2', 'doc' || l_suppkey, md5(l_suppkey::varchar), 'sheet' || l_returnflag FROM lineitem WHERE l_suppkey <> l_partkey)
GROUP BY ALL"""


def sheet_names(t: Tables):
    return t.raw("part").select("p_partkey", sheet_name_key(F.concat_ws(" ", "p_name", "p_brand")).alias("sheet_key"))


QUERIES = {
    "f01_clean_text": (clean_text, f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS clean_len FROM (SELECT doc_id, {clean('text')} AS c FROM documents)"),
    "f02_clean_preview": (clean_preview, CLEAN_PREVIEW_SQL),
    "f03_truncate": (truncate, TRUNCATE_SQL),
    "f04_markdown": (markdown, f"SELECT doc_id, md5({_markdown_sql(MD)}) AS plain_md5 FROM documents"),
    "f05_f06_keys": (keys, KEYS_SQL),
    "f07_page_id": (page_ids, PAGE_IDS_SQL),
    "f08_f09_confidence_tier": (confidence, CONFIDENCE_SQL),
    "f13_page_text_quality": (page_quality, PAGE_QUALITY_SQL),
    "f22_f23_periods": (periods, PERIODS_SQL),
    "f24_pairs_to_map": (pair_maps, PAIR_MAPS_SQL),
    "f25_f26_lists": (lists, LISTS_SQL),
    "f27_f28_graph_labels": (labels, LABELS_SQL),
    "f29_source_snapshot": (snapshot, SNAPSHOT_SQL),
    "f30_mask": (masks, MASKS_SQL),
    "f32_f33_line_types": (line_types, LINE_TYPES_SQL),
    "f35_sheet_name_key": (sheet_names, f"SELECT p_partkey, {rr('p_name || p_brand', chr(92) + 's+')} AS sheet_key FROM part"),
    "f36_citations": (citation_rows, CITATIONS_SQL),
}
