"""SQL building blocks for the checks: the same derived tables, in DuckDB SQL."""

from __future__ import annotations

import re

from marginalia import constants as C

PROFILE_LIST = "['general','design','policy','ops']"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ",".join(lit(w) for w in words) + "]"


def has_any(expr: str, words) -> str:
    return f"(len(list_filter({sql_list(words)}, lambda w: contains({expr}, w))) > 0)"


def n_hits(expr: str, words) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains({expr}, w)))"


def rr(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def strip(expr: str) -> str:
    return rr(expr, r"^\s+|\s+$")


def clean(expr: str) -> str:
    """clean_text for text without CJK letters."""
    t = rr(f"coalesce({expr}, '')", r"\r\n?", "\n")
    t = rr(t, r"[ \t]+", " ")
    t = rr(t, r"\n\s*\n\s*\n+", "\n\n")
    return strip(t)


def node_key(expr: str) -> str:
    return rr(f"lower({expr})", r"\s+")


FILE_COLS = f"""md5(doc_id::varchar) AS file_md5, 'doc_' || doc_id || '.txt' AS file_name,
  doc_id % 20 + 1 AS user_id,
  CASE WHEN doc_id % 10 = 0 THEN 'DEFAULT' ELSE 'N' || (doc_id % 25) END AS org_tag,
  doc_id % 7 = 0 AS is_public, {PROFILE_LIST}[doc_id % 4 + 1] AS kb_profile"""

K = "json_extract_string(props, '$.k')::int"

TABLES = {
    "files": f"""SELECT doc_id, {FILE_COLS}, n_chars AS total_size, 3 AS status,
      TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS created_at FROM documents""",
    "blocks": """SELECT doc_id, lang, md5(doc_id::varchar) AS file_md5, block_index, 'text' AS type, text,
      (block_index // 20 + 1)::int AS page
      FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
        unnest(range(len(string_split(text, chr(10))))) AS block_index FROM documents)""",
    "cleaned": f"SELECT doc_id, {clean('text')} AS ct FROM documents",
    "pieces": f"""SELECT doc_id, list_filter(CASE WHEN length(ct) > 1800 THEN
        list_transform(list_concat(list_transform(range(0, greatest(ceil((length(ct) - 900) / 780.0), 0)::int + 1),
          lambda i: i * 780), [length(ct) - 120]), lambda s: {clean('substr(ct, s + 1, 900)')})
        ELSE [ct] END, lambda p: p <> '') AS ps FROM cleaned""",
    "chunks": f"""SELECT doc_id, {FILE_COLS}, chunk_id, text_content
      FROM (SELECT doc_id, unnest(ps) AS text_content, unnest(range(len(ps)))::int AS chunk_id FROM pieces)""",
    "chunk_quality": """SELECT md5(doc_id::varchar) AS file_md5,
      CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'weak' END AS quality_status
      FROM labels""",
    "queries": f"""SELECT item_id AS query_id, item_id % 20 + 1 AS user_id,
      text AS query,
      {PROFILE_LIST}[item_id % 4 + 1] AS profile FROM benchmark""",
    "questions": f"""SELECT 'b' || item_id AS question_id, text AS question, {PROFILE_LIST}[item_id % 4 + 1] AS profile
      FROM benchmark UNION ALL SELECT 'c_' || conv_id || '_' || turn, text, {PROFILE_LIST}[conv_id % 4 + 1]
      FROM conversations WHERE role = 'user'""",
    "users": """SELECT user_id, CASE WHEN user_id = 1 THEN 'ADMIN' ELSE 'USER' END AS role,
      ['R' || (user_id % 5), 'S' || (user_id % 10)] AS tags
      FROM (SELECT DISTINCT user_id FROM events WHERE user_id > 0)""",
    "org_tags": """SELECT 'R' || r_regionkey AS tag_id, NULL AS parent_tag FROM region
      UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
      UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier""",
    "tag_closure": """SELECT tag_id AS root, tag_id AS tag_id, 0 AS depth FROM org_tags
      UNION ALL SELECT c.root, o.tag_id, c.depth + 1 FROM tag_closure c JOIN org_tags o ON o.parent_tag = c.tag_id""",
    "user_tags": """SELECT DISTINCT user_id, tag_id FROM (
      SELECT user_id, 'DEFAULT' AS tag_id FROM users UNION ALL
      SELECT user_id, unnest(tags) FROM users UNION ALL
      SELECT u.user_id, c.tag_id FROM (SELECT user_id, unnest(tags) AS t FROM users) u JOIN tag_closure c ON c.root = u.t)""",
    "visible": """SELECT u.user_id, f.file_md5 FROM users u, files f
      WHERE u.role = 'ADMIN' OR f.user_id = u.user_id OR f.is_public OR f.org_tag = 'DEFAULT'
      OR EXISTS (SELECT 1 FROM user_tags t WHERE t.user_id = u.user_id AND t.tag_id = f.org_tag)""",
    "usage_events": f"""SELECT event_id, user_id,
      CASE event_type WHEN 'signup' THEN 'no_evidence' WHEN 'error' THEN 'error' ELSE 'success' END AS status,
      ['fact_lookup','flow_query','layout_query','schedule_query','compare_query','timeline_query',' '][{K} % 7 + 1] AS intent,
      {PROFILE_LIST}[user_id % 4 + 1] AS selected_profile, {K} % 5 AS retrieval_count, {K} % 3 AS source_count,
      floor(value * 100)::int AS latency_ms, ts AS created_at, 'question ' || event_id AS question_text FROM events""",
    "messages": """SELECT conv_id AS conversation_id, conv_id % 20 + 1 AS user_id, turn AS seq, role, text AS content,
      TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id + INTERVAL 1 MINUTE * turn AS ts FROM conversations""",
    "edge_pairs": """SELECT DISTINCT c_nationkey AS file_no, c_name, s_name, s_nationkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey""",
    "raw_edges": """SELECT file_no, c_name AS src, s_name AS dst, '依赖' AS relation_type FROM edge_pairs
      UNION SELECT file_no, s_name, n_name, '连接' FROM edge_pairs JOIN nation ON s_nationkey = n_nationkey
      UNION SELECT file_no, n_name, r_name, '输出' FROM edge_pairs JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "relation_edges": """SELECT md5('nation' || file_no) AS file_md5, 'graph_' || file_no AS file_name,
      src || '->' || relation_type || '->' || dst AS edge_id, src, dst, relation_type, length(src) % 7 AS page
      FROM raw_edges""",
    "sheet_cells": """SELECT md5((o_custkey % 25)::varchar) AS file_md5, 'sheet_' || (o_custkey % 25) AS sheet,
      o_custkey::int AS "row", ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::int AS col,
      min(o_orderstatus) AS fill_sig FROM orders GROUP BY ALL""",
    "upload_parts": "SELECT DISTINCT md5(l_orderkey::varchar) AS file_md5, l_linenumber - 1 AS chunk_index FROM lineitem",
    "upload_totals": """SELECT md5(l_orderkey::varchar) AS file_md5, max(l_linenumber) AS total_chunks
      FROM lineitem GROUP BY 1""",
    "parse_requests": f"""SELECT event_id, user_id, md5(event_type || {K}) AS file_md5,
      CASE WHEN {K} <> 0 THEN 'file_' || {K} END AS file_name, 'docs/' || user_id AS storage_path, ts FROM events""",
    "unit_parents": """SELECT file_md5, chunk_id AS parent_chunk_id, 'u' || (chunk_id % 3) AS document_unit_key, text_content,
      length(text_content) % 100 AS quality_score, coalesce(quality_status, 'weak') AS quality_status FROM chunks LEFT JOIN chunk_quality USING (file_md5)""",
    "visual_pages": f"""SELECT vec_id AS visual_page_id, md5(vec_id::varchar) AS file_md5, 'u' || (vec_id % 3) AS document_unit_key, vec_id % 20 + 1 AS user_id,
      CASE WHEN vec_id % 10 = 0 THEN 'DEFAULT' ELSE 'N' || (vec_id % 25) END AS org_tag, vec_id % 7 = 0 AS is_public,
      {PROFILE_LIST}[vec_id % 4 + 1] AS kb_profile, 'sheet_' || label AS sheet, 'page:' || (vec_id % 40 + 1) AS page_label,
      CASE WHEN vec_id % 10 = 0 THEN 'pending_provider' ELSE 'indexed' END AS status,
      ['accepted','weak','rejected'][vec_id % 3 + 1] AS quality_status, embedding AS vector FROM embeddings""",
    "part_blocks": """SELECT md5(p_type) AS file_md5, p_partkey::int AS block_index,
      CASE WHEN p_size % 10 = 0 THEN 'schedule_row' ELSE 'table_row' END AS type,
      'brand: ' || p_brand || ' ; type: ' || p_type || ' ; size: ' || p_size || ' ; name: ' || p_name AS text,
      p_brand AS sheet, p_partkey AS row_no, p_brand, p_type, p_size, p_name FROM part""",
    "profiles": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{p[0]}', {lit(p[4])}, {p[5]}, {p[6]}, {p[7]}::double, {p[8]}::double, {p[9]}, {p[10]}, "
        f"{p[11]}::double, {p[12]}::double, {p[13]}::double)"
        for p in C.PROFILES
    )
    + """) t(profile_id, query_expand_terms, ocr_min_chars, ocr_min_words, ocr_min_valid_ratio,
      ocr_doc_trigger_ratio, ocr_no_text_streak, ocr_max_pages, w_vector, w_bm25, w_relation)""",
}


def _uses(sql: str) -> set[str]:
    return {t for t in TABLES if re.search(rf"\b{t}\b", sql)}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Put the derived tables a query (and its own named steps) needs in front of it."""
    extra = extra or {}
    need: list[str] = []

    def add(name):
        if name in need:
            return
        for dep in sorted(_uses(TABLES[name]) - {name}):
            add(dep)
        need.append(name)

    for sql in [*extra.values(), body]:
        for t in sorted(_uses(sql)):
            if t not in extra:
                add(t)
    ctes = [f"{n} AS ({TABLES[n]})" for n in need] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
