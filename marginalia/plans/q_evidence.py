"""Registered queries: evidence after retrieval, answers, memory, timeline."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.operators import conversations as M, evidence as E, retrieval as R
from marginalia.plans.oracle import PROFILE_LIST, has_any, sql_list, with_tables
from marginalia.plans.q_access import files_with_tokens, users_with_tokens
from marginalia.plans.q_questions import intent_sql, preference_sql
from marginalia.plans.sequence import top_rows
from marginalia.plans.tables import Tables

KW = C.INTENT_KEYWORDS
TEXTS = ["overview flow of ring", "upstream flow widget", "layout of the bolt", "small ring gear please", "diagram flow list anvil"]


def asked(t: Tables):
    k = F.col("s_suppkey")
    q = t.raw("supplier").select(
        k.alias("query_id"), F.element_at(F.array(*[F.lit(x) for x in TEXTS]), (k % 5 + 1).cast("int")).alias("query"),
        F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (F.floor(k / 5) % 4 + 1).cast("int")).alias("profile"), (k % 2 == 0).alias("strict"),
    )
    return q.withColumn("intent", Q.intent(F.col("query")))


def found(t: Tables):
    """All line items of a supplier as the hits of a question."""
    p = t.raw("part").select("p_partkey", "p_name", "p_brand", "p_type")
    k = F.col("l_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("[关系] "), "p_name", F.lit(" --连接--> "), "p_brand"))
        .when(k == 1, F.concat(F.lit("[diagram_page] "), "p_name"))
        .when(k == 2, F.concat("p_name", F.lit(" 入力> "), "p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    )
    l = t.raw("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("query_id"), F.md5("p_type").alias("file_md5"), F.concat(F.lit("file "), "p_type").alias("file_name"),
        F.col("l_partkey").alias("chunk_id"), text.alias("text_content"), F.round(F.col("l_discount") + F.col("l_tax"), 4).alias("score"),
        F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("img/"), "l_partkey")).alias("image_path"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "chunk_id", "l_quantity", "l_extendedprice", "score")]
    return l.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).drop(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


HITS = {
    "aq": f"""SELECT *, {intent_sql('query')} AS intent, {preference_sql('query')} AS pref FROM (SELECT s_suppkey AS query_id, {sql_list(TEXTS)}[s_suppkey % 5 + 1] AS query, {PROFILE_LIST}[s_suppkey // 5 % 4 + 1] AS profile, s_suppkey % 2 = 0 AS strict FROM supplier)""",
    "hh": """SELECT * FROM (SELECT l_suppkey AS query_id, md5(p_type) AS file_md5, 'file ' || p_type AS file_name, l_partkey AS chunk_id,
      CASE l_partkey % 6 WHEN 0 THEN '[关系] ' || p_name || ' --连接--> ' || p_brand WHEN 1 THEN '[diagram_page] ' || p_name WHEN 2 THEN p_name || ' 入力> ' || p_brand
        ELSE p_name || ' ' || p_type || ' ' || p_brand END AS text_content, round(l_discount + l_tax, 4) AS score, CASE WHEN l_partkey % 7 = 0 THEN 'img/' || l_partkey END AS image_path,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, round(l_discount + l_tax, 4)) AS rank
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "kd": "SELECT *, chunk_id % 6 IN (0, 2) AS is_relation, chunk_id % 6 = 1 OR image_path IS NOT NULL AS is_visual FROM hh",
}


def kinds(t: Tables):
    return E.with_kinds(found(t)).select("query_id", "rank", "is_relation", "is_visual")


def guarded(t: Tables):
    return E.guardrails(found(t), asked(t)).select("query_id", "chunk_id", "rank", "is_relation").distinct()


GUARD = {**HITS,
    "gr": "SELECT k.*, pref, profile, query, count(*) FILTER (is_relation AND profile <> 'policy') OVER (PARTITION BY query_id) AS n_rel, row_number() OVER (PARTITION BY query_id, is_relation ORDER BY rank) AS nth FROM kd k JOIN aq USING (query_id)",
    "gk": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pref = 'mixed' AND is_relation THEN 0 ELSE 1 END, rank) AS new_rank FROM gr
      WHERE NOT (is_relation AND profile = 'policy') AND CASE pref WHEN 'relation' THEN CASE WHEN n_rel > 0 THEN is_relation ELSE {has_any('query', KW['VISUAL_DIAGRAM_REQUEST_KEYS'])} END WHEN 'mixed' THEN nth <= 4 ELSE NOT is_relation END""",
}


def critic(t: Tables):
    """The suppliers' questions, and the benchmark items as questions without any hit."""
    hits = found(t).withColumn("score", F.when(F.col("query_id") % 7 == 0, F.col("score") / 10).otherwise(F.col("score")))
    lone = t.raw("benchmark").select((-F.col("item_id") - 1).alias("query_id"), F.col("text").alias("query"), F.lit("general").alias("profile"))
    return E.critic(hits, asked(t).select("query_id", "query", "profile").unionByName(lone))


_SYN = "CASE query_id % 5 WHEN 0 THEN ['overview','ring'] WHEN 1 THEN ['upstream','widget'] WHEN 2 THEN ['layout','the','bolt'] WHEN 3 THEN ['small','ring','gear'] ELSE ['list','anvil'] END"
CRITIC_SQL = with_tables("""SELECT query_id, CASE WHEN top IS NULL THEN 'EVIDENCE_EMPTY' WHEN NOT met THEN 'ANCHOR_MISMATCH' WHEN top < 0.18::double THEN 'EVIDENCE_WEAK' ELSE 'PASS' END AS code FROM (
  SELECT q.query_id, max(CASE WHEN q.query_id % 7 = 0 THEN score / 10 ELSE score END) AS top, coalesce(bool_or(len(list_filter(anchors, lambda a: contains(regexp_replace(lower(file_name || text_content), '[\\s_|-]+', '', 'g'), a))) > 0), false) AS met
  FROM ga q LEFT JOIN hh h ON h.query_id = q.query_id GROUP BY 1)""", {**HITS,
    # anchors per question text; presentation questions (with 'flow' or 'diagram') lose anchors that name a diagram or flow
    "ga": """SELECT query_id, CASE query_id % 5 WHEN 0 THEN ['overview','ring'] WHEN 1 THEN ['widget','upstream'] WHEN 2 THEN ['layout','the','bolt'] WHEN 3 THEN ['small','ring','gear'] ELSE ['list','anvil'] END AS anchors FROM aq UNION ALL SELECT -item_id - 1, [] FROM benchmark""",
})


def focus(t: Tables):
    f = E.document_focus(found(t), asked(t), 8)
    return f.select("query_id", "file_md5", "chunk_id", F.round("score", 6).alias("score"), "rank")


FOCUS = {**HITS,
    # anchors are the first eight tokens left after stop words; strong anchors the first four of three letters or more
    "an": f"""SELECT query_id, strict, query, x AS anchors, list_slice(list_filter(x, lambda a: length(a) >= 3 AND NOT list_contains({sql_list(C.STRONG_STOP_WORDS)}, a)), 1, 4) AS strong, {has_any('query', KW['LAYOUT_QUERY_KEYS'])} AS layout
      FROM (SELECT *, string_split(query, ' ') AS x FROM aq)""",
    "ah": """SELECT h.*, strict AND NOT layout AS st, len(list_filter(anchors, lambda a: contains(t, a))) AS a, len(list_filter(strong, lambda a: contains(t, a))) AS s
      FROM (SELECT *, regexp_replace(lower(file_name || ' ' || text_content), '[\\s_|-]+', '', 'g') AS t FROM hh) h JOIN an USING (query_id)""",
    "af": """SELECT query_id, file_md5, st, round(max(score) + 0.08::double * count(*) + 0.25::double * sum(a), 9) AS strength, sum(s) AS sh, min(rank) AS seen FROM ah GROUP BY 1, 2, 3""",
    "ag": """SELECT *, count(*) OVER (PARTITION BY query_id) AS nf, max(sh) OVER (PARTITION BY query_id) AS best, row_number() OVER w AS place, lead(strength) OVER w AS nxt
      FROM af WINDOW w AS (PARTITION BY query_id ORDER BY strength + 0.5::double * sh DESC, seen)""",
    "al": "SELECT query_id, strength >= nxt * 1.12::double OR strength - nxt >= 0.25::double AS dom FROM ag WHERE place = 1",
    "ak": """SELECT query_id, file_md5, nf > 1 AND st AND best = 0 AS soft FROM ag JOIN al USING (query_id)
      WHERE CASE WHEN nf > 1 AND st AND best > 0 THEN sh = best WHEN nf > 1 AND dom THEN place = 1 ELSE true END""",
    "ar": "SELECT query_id, file_md5, chunk_id, round(CASE WHEN soft THEN score * 0.82::double ELSE score END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hh JOIN ak USING (query_id, file_md5)",
}


def promoted(t: Tables):
    src = t.raw("part").select(F.md5("p_type").alias("file_md5"), F.col("p_partkey").alias("chunk_id"), F.when(F.col("p_size") % 3 == 0, "img").otherwise("").alias("image_path"))
    p = E.promote_layout(found(t), src, 6)
    return p.select("query_id", "chunk_id", "rank", F.round("promoted_score", 6).alias("promoted_score"))


PROMOTE_SQL = with_tables("""SELECT query_id, chunk_id, rank, round(ps, 6) AS promoted_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ps, 9) DESC, old) AS rank FROM (
  SELECT k.query_id, chunk_id, k.rank AS old, score + CASE WHEN chunk_id % 6 = 1 THEN 0.35::double ELSE 0 END + CASE WHEN is_visual THEN 0.45::double ELSE 0 END
    + CASE WHEN CASE WHEN is_visual THEN image_path IS NOT NULL ELSE p_size % 3 = 0 END THEN 0.55::double ELSE 0 END AS ps FROM kd k JOIN part ON p_partkey = chunk_id)) WHERE rank <= 6""", HITS)


def three_ways(t: Tables):
    base = E.with_kinds(found(t))
    w = R.channel_weights(t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS))

    def channel(df):
        return top_rows(df.drop("rank").withColumnRenamed("_o", "o"), ["query_id"], [F.col("o")], 12)

    base = base.groupBy("query_id", "file_md5", "chunk_id").agg(F.min("rank").alias("_o"), *[F.first(c).alias(c) for c in ("text_content", "image_path", "is_relation", "is_visual")])
    f = E.fuse_three(
        channel(base), channel(base.filter("is_relation")), channel(base.filter("is_visual").withColumn("source_type", F.lit("visual"))), asked(t), w, 8)
    return f.select("query_id", F.col("chunk_id").cast("long").alias("chunk_id"), "rank", F.round("final_score", 9).alias("final_score"))


THREE = {
    "aq": HITS["aq"],
    "h3": HITS["hh"],
    "u3": "SELECT query_id, file_md5, chunk_id, min(rank) AS o, any_value(chunk_id % 6 IN (0, 2)) AS is_relation, any_value(chunk_id % 6 = 1 OR image_path IS NOT NULL) AS is_visual FROM h3 GROUP BY 1, 2, 3",
    "c3": """SELECT * FROM (SELECT *, 0 AS ch, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM u3 UNION ALL SELECT *, 1, row_number() OVER (PARTITION BY query_id ORDER BY o) FROM u3 WHERE is_relation
      UNION ALL SELECT *, 2, row_number() OVER (PARTITION BY query_id ORDER BY o) FROM u3 WHERE is_visual) WHERE rank <= 12""",
    "w3": "SELECT profile_id AS profile, v, (1 - v) * (w_vector + w_bm25) / (w_vector + w_bm25 + w_relation) AS h, (1 - v) * w_relation / (w_vector + w_bm25 + w_relation) AS r FROM (SELECT *, CASE WHEN profile_id = 'design' THEN 0.18::double ELSE 0.12::double END AS v FROM profiles)",
    "f3": """SELECT query_id, chunk_id, file_md5, round(sum(CASE ch WHEN 0 THEN h WHEN 1 THEN r ELSE v END / (60 + rank)), 12) AS rrf, min({'c': ch, 'r': rank}) AS seen, any_value(pref) AS pref, any_value(profile) AS profile,
      any_value(is_relation) AS rel, any_value(is_visual) OR min(ch) = 2 AS vis FROM c3 JOIN aq USING (query_id) JOIN w3 USING (profile) GROUP BY 1, 2, 3""",
    "g3": """SELECT *, round(rrf + CASE pref WHEN 'relation' THEN CASE WHEN rel THEN 0.25::double ELSE 0 END WHEN 'text' THEN CASE WHEN vis THEN 0.24::double WHEN NOT rel THEN 0.1::double ELSE 0 END
      ELSE CASE WHEN rel THEN 0.12::double WHEN vis THEN 0.1::double ELSE 0.06::double END END + CASE WHEN profile IN ('design', 'ops') AND rel THEN 0.08::double ELSE 0 END
      + CASE WHEN profile = 'design' AND vis THEN 0.14::double ELSE 0 END - CASE WHEN profile = 'policy' AND rel THEN 0.05::double ELSE 0 END, 12) AS fs FROM f3""",
}


def package(t: Tables):
    return E.context_package(found(t), asked(t)).select("query_id", "chunk_id", "mode", "position")


def context(t: Tables):
    c = E.context_text(E.context_package(found(t), asked(t)))
    return c.select("query_id", "mode", F.length("context").alias("n_chars"), "citations", "n_sources")


PACK = {**HITS,
    "pm": f"""SELECT query_id, CASE WHEN intent = 'layout_query' THEN 'text_plus_image' WHEN intent = 'flow_query' AND {has_any('query', KW['VISUAL_DIAGRAM_REQUEST_KEYS'] + C.VISUAL_WISH_KEYS)} THEN 'graph_plus_text_plus_image'
      WHEN intent = 'flow_query' THEN 'graph_plus_text' ELSE 'text_only' END AS mode FROM aq""",
    "p1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_md5, chunk_id ORDER BY rank) AS d FROM kd) WHERE d = 1",
    "p2": "SELECT *, NOT is_relation AND NOT is_visual AS plain, count(*) FILTER (NOT is_relation AND NOT is_visual) OVER (PARTITION BY query_id) AS np FROM p1 JOIN pm USING (query_id)",
    "p3": "SELECT *, CASE WHEN np > 0 THEN plain ELSE NOT is_relation END AS tx FROM p2",
    "p4": """SELECT *, count(*) FILTER (tx) OVER w AS t, count(*) FILTER (is_relation) OVER w AS r, count(*) FILTER (is_visual) OVER w AS v, row_number() OVER w AS a, count(*) FILTER (tx) OVER (PARTITION BY query_id) AS nt
      FROM p3 WINDOW w AS (PARTITION BY query_id ORDER BY rank)""",
    "p5": """SELECT *, coalesce(CASE WHEN mode LIKE 'graph%' AND is_relation AND r <= 4 THEN r END, CASE WHEN tx AND t <= CASE WHEN mode LIKE 'graph%' THEN 2 WHEN mode LIKE '%image' THEN 4 ELSE 6 END THEN t + 10 END,
      CASE WHEN mode LIKE '%image' AND is_visual AND v <= 1 THEN v + 20 END, CASE WHEN mode = 'text_only' AND nt = 0 AND a <= 6 THEN a + 10 END) AS p FROM p4""",
    "p6": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS position FROM p5 WHERE p IS NOT NULL",
}
CONTEXT_SQL = with_tables("""SELECT query_id, mode, sum(n) + count(*) - 1 AS n_chars, array_to_string(list_slice(list(m ORDER BY position), 1, 5), chr(10)) AS citations, count(*) AS n_sources FROM (
  SELECT *, length('[文書' || position || ']' || chr(10) || 'ファイル: ' || file_name || chr(10) || 'チャンク: ' || chunk_id || chr(10) || CASE WHEN mode LIKE '%image' THEN '画像: ' || coalesce(image_path, '-') || chr(10) ELSE '' END
    || '証拠タイプ: ' || CASE WHEN is_relation THEN 'graph' WHEN is_visual THEN 'visual' ELSE 'text' END || chr(10) || '内容: ' || text_content || chr(10)) AS n,
    '[[SRC|' || position || '|' || file_name || '|' || file_md5 || '|' || chunk_id || '||]]' AS m FROM p6) GROUP BY 1, 2""", PACK)


def stats_answer(t: Tables):
    return E.statistics_answer(found(t))


def compare(t: Tables):
    c = E.compare_answer(found(t), asked(t).withColumn("profile", F.lit("general")))
    return c.select("query_id", "i", "anchor", "matches", F.coalesce(F.array_join("snippets", "~"), F.lit("")).alias("snippets"))


def preview(t: Tables):
    s = t.raw("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity")).select(
        F.md5((F.col("l_orderkey") % 50).cast("string")).alias("file_md5"), F.floor(F.col("l_orderkey") / 50).cast("int").alias("chunk_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("source_order"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("sheet"),
        F.when(F.col("l_quantity") > 10, (F.col("l_quantity") % 4).cast("int")).alias("page"), F.when(F.col("l_partkey") % 9 == 0, F.concat(F.lit("img/"), "l_partkey")).alias("image_path"),
    )
    img = t.raw("supplier").select(F.md5((F.col("s_suppkey") % 50).cast("string")).alias("file_md5"), F.concat(F.lit("s"), F.col("s_suppkey") % 3).alias("sheet"), (F.col("s_suppkey") % 4).cast("int").alias("page"),
                                   F.col("s_suppkey").alias("image_no"), F.concat(F.lit("blk/"), "s_suppkey").alias("storage_path"))
    p = E.chunk_preview(s, img)
    return p.select("file_md5", "chunk_id", "top_sheet", F.coalesce("top_page", F.lit(-1)).alias("top_page"), "preview_rows", F.array_join("images", ",").alias("images"))


PREVIEW = {
    "ps": """SELECT md5((l_orderkey % 50)::varchar) AS file_md5, (l_orderkey // 50)::int AS chunk_id, l_partkey * 10 + l_linenumber AS o, 's' || (min(l_suppkey) % 3) AS sheet,
      CASE WHEN min(l_quantity) > 10 THEN (min(l_quantity) % 4)::int END AS page, CASE WHEN l_partkey % 9 = 0 THEN 'img/' || l_partkey END AS path FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber""",
    "pd": """SELECT DISTINCT file_md5, chunk_id, first_value(sheet) OVER (PARTITION BY file_md5, chunk_id ORDER BY ns DESC, os) AS top_sheet FROM (SELECT file_md5, chunk_id, sheet, count(*) AS ns, min(o) AS os FROM ps GROUP BY 1, 2, 3)""",
    "pp": """SELECT DISTINCT file_md5, chunk_id, first_value(page) OVER (PARTITION BY file_md5, chunk_id ORDER BY np DESC, op) AS top_page FROM (SELECT file_md5, chunk_id, page, count(*) AS np, min(o) AS op FROM ps WHERE page IS NOT NULL GROUP BY 1, 2, 3)""",
    "pj": "SELECT ps.*, top_sheet, top_page, sheet = top_sheet AND (top_page IS NULL OR page IS NULL OR page = top_page) AS sc FROM ps JOIN pd USING (file_md5, chunk_id) LEFT JOIN pp USING (file_md5, chunk_id)",
    "pt": "SELECT file_md5, chunk_id, path, min(o) FILTER (sc) AS own, min(o) AS o FROM pj WHERE path IS NOT NULL GROUP BY 1, 2, 3",
    "pi": "SELECT file_md5, chunk_id, list(path ORDER BY own) FILTER (own IS NOT NULL) AS mine, list(path ORDER BY o) AS anyp FROM pt GROUP BY 1, 2",
    "pg2": "SELECT file_md5, chunk_id, any_value(top_sheet) AS top_sheet, any_value(top_page) AS top_page, count(*) FILTER (sc) AS ns, count(*) AS n FROM pj GROUP BY 1, 2",
    "pe": """SELECT g.file_md5, g.chunk_id, list('blk/' || s_suppkey ORDER BY s_suppkey) AS extra FROM pg2 g JOIN supplier ON md5((s_suppkey % 50)::varchar) = g.file_md5 AND 's' || (s_suppkey % 3) = top_sheet AND (top_page IS NULL OR s_suppkey % 4 = top_page) GROUP BY 1, 2""",
}


def plans(t: Tables):
    prof = t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS).select(F.col("profile_id").alias("profile"), "enable_relation_index")
    q = t.questions().select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "profile").withColumn("intent", Q.intent(F.col("query")))
    return E.retrieval_plan(q, prof)


_L = "lower(question)"
PLAN_SQL = with_tables(f"""SELECT question_id AS query_id, CASE WHEN i = 'layout_query' THEN 'layout' WHEN wr THEN 'flow' ELSE 'general' END AS route,
  i <> 'layout_query' AND profile <> 'policy' AS use_relation, CASE WHEN i = 'layout_query' THEN true WHEN wr THEN false ELSE {has_any('l', KW['VISUAL_DIAGRAM_REQUEST_KEYS'])} END AS use_visual,
  CASE WHEN i = 'layout_query' THEN 10 ELSE 8 END AS top_k, i = 'layout_query' AS promote
FROM (SELECT *, lower(question) AS l, {intent_sql(_L)} AS i, len(list_filter({sql_list(KW['STRICT_RELATION_KEYS'])}, lambda w: contains({_L}, w))) >= CASE WHEN {intent_sql(_L)} = 'flow_query' THEN 1 ELSE 2 END AS wr FROM questions)""")


def schedule_match(t: Tables):
    k = F.col("p_partkey")
    rows = t.raw("part").select(
        F.md5((k % 200).cast("string")).alias("file_md5"), k.alias("row_id"), F.col("p_brand").alias("sheet"), F.col("p_name").alias("task"), F.col("p_type").alias("detail"),
        F.lit("").alias("raw_text"), F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES]), (k % 200 % 4 + 1).cast("int")).alias("kb_profile"), (F.col("p_size") / 100).alias("confidence"))
    q = asked(t).withColumn("user_id", F.col("query_id") % 20 + 1).withColumn("query", F.when(F.col("query_id") % 6 == 0, "?").otherwise(F.col("query")))
    q = q.join(users_with_tokens(t).select("user_id", "tokens"), "user_id")
    return E.schedule_matches(rows, q, files_with_tokens(t)).select("query_id", "row_id", "score", "rank")


SCHED = {
    "aq": HITS["aq"],
    "sr": f"SELECT md5((p_partkey % 200)::varchar) AS file_md5, p_partkey AS row_id, lower(p_brand || ' ' || p_name || ' ' || p_type || ' ') AS hay, {PROFILE_LIST}[p_partkey % 200 % 4 + 1] AS kb_profile, p_size / 100.0::double AS confidence FROM part",
    "sq": "SELECT query_id, query_id % 20 + 1 AS user_id, profile, CASE WHEN query_id % 6 = 0 THEN [] ELSE list_distinct(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{1,32}')) END AS kw FROM aq",
    "sm": "SELECT query_id, row_id, len(kw) AS nk, len(list_filter(kw, lambda w: contains(hay, lower(w)))) AS hit, CASE WHEN kb_profile = profile THEN 1 ELSE 0 END + confidence AS extra FROM sq JOIN visible USING (user_id) JOIN sr USING (file_md5)",
    "ss": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hit + extra, 6) DESC, row_id) AS rank FROM sm WHERE hit > 0 OR nk = 0",
}


def schedule_answer(t: Tables):
    k = F.col("p_partkey")
    end = F.concat(F.lit("2024-"), (k % 9 + 3).cast("string"))
    text = F.concat(F.lit("[schedule] sheet="), "p_brand", F.lit(" ; task="), "p_name", F.lit(" ; period=2024-2 -> "), end, F.when(k % 2 == 0, F.concat(F.lit(" ; detail="), "p_type")).otherwise(""), F.lit(" ; confidence=0."), (F.col("p_size") + 10).cast("string"))
    hits = t.raw("part").select((k % 100).alias("query_id"), F.floor(k / 100).alias("rank"), text.alias("text_content"), F.lit("f").alias("file_name"))
    q = t.raw("supplier").select(F.col("s_suppkey").alias("query_id"), F.lit("when does small ring or hot bolt end").alias("query"))
    return E.schedule_answers(hits, q)


SCHED_ANSWER = {
    "sa": """SELECT p_partkey % 100 AS query_id, p_partkey // 100 AS rank, p_brand AS sheet, p_name AS task, '2024-' || (p_partkey % 9 + 3) AS e, p_partkey % 9 + 2 AS months, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS detail,
      ('0.' || (p_size + 10))::double AS confidence, p_name IN ('small ring', 'hot bolt') AS named FROM part WHERE p_partkey % 100 IN (SELECT s_suppkey FROM supplier)""",
    "sb": "SELECT *, bool_or(named) OVER (PARTITION BY query_id) AS an FROM sa",
    "sc2": "SELECT *, max(confidence) OVER (PARTITION BY query_id) AS tc, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM sb WHERE named OR NOT an",
}


def memory_messages(t: Tables):
    s = F.col("seq")
    word = F.regexp_extract("content", "([A-Za-z]{3,10})", 1)
    c = (
        F.when(s % 7 == 0, F.concat(F.lit("sheet "), word, F.lit(" count "), "content")).when(s % 7 == 2, F.concat(word, F.lit("の期間 of all the long running work "), "content"))
        .when(s % 7 == 4, F.lit("それ?")).otherwise(F.col("content"))
    )
    return t.messages().withColumn("content", c)


def memory(t: Tables):
    m = M.with_memory(memory_messages(t))
    return m.select("conversation_id", "seq", "subject", "constraint", "scope", "old_subject", "old_constraint", "old_scope", "is_followup", F.md5("effective_text").alias("text_md5"))


_CON = "CASE " + " ".join(f"WHEN {has_any('c', w)} THEN '{n}'" for n, w in C.CONSTRAINT_WORDS.items()) + " ELSE '' END"
MEMORY = {
    "mm": """SELECT conversation_id, seq, regexp_replace(CASE seq % 7 WHEN 0 THEN 'sheet ' || w || ' count ' || content WHEN 2 THEN w || 'の期間 of all the long running work ' || content WHEN 4 THEN 'それ?' ELSE content END, '', '') AS raw FROM (
      SELECT *, regexp_extract(content, '([A-Za-z]{3,10})', 1) AS w FROM messages WHERE role = 'user')""",
    "mc": r"SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS c FROM mm",
    "ms": rf"""SELECT *, CASE WHEN regexp_matches(c, '[A-Za-z0-9_/-]{{2,40}}の期間') THEN regexp_extract(c, '([A-Za-z0-9_/-]{{2,40}})の期間', 1) ELSE '' END AS subject, {_CON} AS con,
      CASE WHEN regexp_matches(c, '(?i)sheet\s*["'']?[0-9A-Za-z_-]{{1,48}}') THEN 'シート:' || regexp_extract(c, '(?i)sheet\s*["'']?([0-9A-Za-z_-]{{1,48}})', 1) ELSE '' END AS scope,
      len(list_filter(regexp_extract_all(c, '[A-Za-z][A-Za-z0-9_-]{{2,32}}'), lambda x: regexp_replace(x, '[_|-]', '', 'g') <> '')) AS n_ent FROM mc""",
    "mo": """SELECT *, coalesce(last_value(nullif(subject, '') IGNORE NULLS) OVER w, '') AS os, coalesce(last_value(nullif(con, '') IGNORE NULLS) OVER w, '') AS oc, coalesce(last_value(nullif(scope, '') IGNORE NULLS) OVER w, '') AS op
      FROM ms WINDOW w AS (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""",
    "mf": f"SELECT *, c <> '' AND subject = '' AND n_ent = 0 AND (length(c) <= 24 OR {has_any('c', C.FOLLOWUP_CUES)}) AS fu, CASE WHEN con <> '' THEN con ELSE oc END AS ec, CASE WHEN scope <> '' THEN scope ELSE op END AS ep FROM mo",
    "mh": "SELECT *, concat_ws(' / ', nullif(ep, ''), CASE WHEN os <> '' AND ec <> '' THEN os || 'の' || ec WHEN os <> '' THEN os WHEN ec <> '' THEN ec END) AS hdr FROM mf",
}


def experience_chunks(t: Tables):
    """Line items as career lines: period, project, role."""
    k = F.col("o_orderkey")
    end = F.when(k % 4 == 0, "present").otherwise(F.concat(F.lit("20"), F.lpad((k % 20 + 4).cast("string"), 2, "0"), F.lit("/"), (k % 12 + 1).cast("string")))
    text = F.concat(
        F.when(k % 10 == 3, "name: Ann Lee\n").otherwise("x "), F.lit("Billing"), (k % 7).cast("string"), F.lit("System "), F.lit("20"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("/"), (k % 14).cast("string"), F.lit(" - "), end,
        F.when(k % 3 == 0, F.lit(" PL in charge; more")).otherwise(" nothing here"))
    return t.raw("orders").select(F.md5((F.col("o_custkey") % 1000).cast("string")).alias("file_md5"), k.alias("chunk_id"), text.alias("text_content"))


def experience(t: Tables):
    e = M.experience_items(experience_chunks(t), 202406)
    return e.select("file_md5", "project_name", "start_ym", "end_ym", "role_summary", "period_text", "source_chunk_id", F.coalesce("person_name", F.lit("-")).alias("person_name"))


EXP = {
    "xo": """SELECT md5((o_custkey % 1000)::varchar) AS file_md5, o_orderkey AS k, 'Billing' || (o_orderkey % 7) || 'System' AS project, (2000 + o_orderkey % 20) * 100 + least(greatest(o_orderkey % 14, 1), 12) AS start_ym,
      CASE WHEN o_orderkey % 4 = 0 THEN 202406 ELSE (2000 + o_orderkey % 20 + 4) * 100 + o_orderkey % 12 + 1 END AS end_ym, CASE WHEN o_orderkey % 3 = 0 THEN 'PL in charge' END AS role,
      '20' || lpad((o_orderkey % 20)::varchar, 2, '0') || '/' || (o_orderkey % 14) || ' - ' || CASE WHEN o_orderkey % 4 = 0 THEN 'present' ELSE '20' || lpad((o_orderkey % 20 + 4)::varchar, 2, '0') || '/' || (o_orderkey % 12 + 1) || ' ' END AS period FROM orders""",
    "xi": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_md5, project, start_ym, end_ym ORDER BY k) AS r FROM xo) WHERE r = 1",
    "xw": "SELECT file_md5, min(k) AS k FROM xo WHERE k % 10 = 3 GROUP BY 1",
}


def timeline(t: Tables):
    i = M.experience_items(experience_chunks(t), 202406).withColumnRenamed("source_chunk_id", "id")
    r = M.recent_items(i, users_with_tokens(t), files_with_tokens(t), (F.col("user_id") % 30 - 2).cast("int"), F.lit("2024-06-15").cast("timestamp_ntz"), F.col("user_id") % 2 == 0)
    return r.select("user_id", "id", "text_content", "rank")


def timeline_rows(t: Tables):
    """The timeline rows of every reader as the hits of a question, parsed back."""
    hits = timeline(t).withColumnRenamed("user_id", "query_id")
    return M.timeline_answer(hits).withColumn("distance", F.coalesce("distance", F.lit("")))


def backfilled(t: Tables):
    i = M.experience_items(experience_chunks(t), 202406)
    return M.backfill_files(i, t.chunks())


QUERIES = {
    "p10_evidence_kinds": (kinds, with_tables("SELECT query_id, rank, is_relation, is_visual FROM kd", HITS)),
    "p11_guardrails": (guarded, with_tables("SELECT DISTINCT query_id, chunk_id, new_rank AS rank, is_relation FROM gk", GUARD)),
    "p12_r16_critic": (critic, CRITIC_SQL),
    "a17_document_focus": (focus, with_tables("SELECT query_id, file_md5, chunk_id, score, rank FROM ar WHERE rank <= 8", FOCUS)),
    "w14_j18_layout_promotion": (promoted, PROMOTE_SQL),
    "r14_three_way_fusion": (three_ways, with_tables("SELECT query_id, chunk_id, rank, round(fs, 9) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs DESC, seen) AS rank FROM g3) WHERE rank <= 8", THREE)),
    "w15_w10_context_package": (package, with_tables("SELECT query_id, chunk_id, mode, position FROM p6", PACK)),
    "f34_context_text": (context, CONTEXT_SQL),
    "a18_statistics_answer": (stats_answer, with_tables("""SELECT query_id, count(*) AS files_hit, sum(n)::bigint AS fragments_hit, arg_max(file_name, {'n': n, 's': -seen}) AS top_file, max(n) AS top_hits
      FROM (SELECT query_id, file_md5, count(*) AS n, min(rank) AS seen, any_value(file_name) AS file_name FROM hh GROUP BY 1, 2) GROUP BY 1""", HITS)),
    "a19_compare_answer": (compare, with_tables("""SELECT query_id, i, anchor, count(h.query_id) AS matches, coalesce(array_to_string(list_slice(list(left(text_content, 120) ORDER BY rank) FILTER (h.query_id IS NOT NULL), 1, 3), '~'), '') AS snippets
      FROM (SELECT query_id, unnest(s) AS anchor, unnest(range(len(s))) AS i FROM (SELECT query_id, list_slice(list_filter(string_split(query, ' '), lambda a: length(a) >= 3 AND a <> 'please'), 1, 4) AS s FROM aq)) q
      LEFT JOIN hh h ON h.query_id = q.query_id AND contains(regexp_replace(lower(text_content), '[\\s_|-]+', '', 'g'), anchor) GROUP BY 1, 2, 3""".replace("SELECT query_id, i, anchor, count", "SELECT q.query_id, i, anchor, count"), HITS)),
    "a20_chunk_preview": (preview, with_tables("""SELECT g.file_md5, g.chunk_id, top_sheet, coalesce(top_page, -1) AS top_page, CASE WHEN ns > 0 THEN ns ELSE n END AS preview_rows,
      array_to_string(list_slice(CASE WHEN len(mine) > 0 THEN mine WHEN len(anyp) > 0 THEN anyp ELSE coalesce(extra, []) END, 1, 3), ',') AS images
      FROM pg2 g LEFT JOIN pi USING (file_md5, chunk_id) LEFT JOIN pe USING (file_md5, chunk_id)""", PREVIEW)),
    "r15_retrieval_plan": (plans, PLAN_SQL),
    "j20_schedule_matches": (schedule_match, with_tables("SELECT query_id, row_id, round(hit + extra, 6) AS score, rank FROM ss WHERE rank <= 10", SCHED)),
    "n06_schedule_answers": (schedule_answer, with_tables("""SELECT query_id, nth, task, sheet, '2024-2' AS period_start, e AS period_end, months || 'か月' AS duration, tc AS top_confidence, detail
      FROM sc2 WHERE nth <= CASE WHEN an THEN 1 ELSE 3 END""", SCHED_ANSWER)),
    "w13_memory": (memory, with_tables("""SELECT conversation_id, seq, subject, con AS "constraint", scope, os AS old_subject, oc AS old_constraint, op AS old_scope, fu AS is_followup,
      md5(CASE WHEN fu AND hdr <> '' THEN hdr || ' について: ' || raw ELSE raw END) AS text_md5 FROM mh""", MEMORY)),
    "n04_x03_experience_items": (experience, with_tables("""SELECT xi.file_md5, project AS project_name, start_ym, end_ym, role AS role_summary, period AS period_text, xi.k AS source_chunk_id,
      CASE WHEN xw.k IS NULL THEN '-' ELSE 'Ann' END AS person_name FROM xi LEFT JOIN xw USING (file_md5)""", EXP)),
    "n05_t05_timeline": (timeline, with_tables("""SELECT user_id, id, text_content, rank FROM (SELECT user_id, k AS id, '[时间线] 项目: ' || project || ' ; 期间: ' || period || ' ; 角色: ' || coalesce(role, '未明确角色')
      || CASE WHEN user_id % 2 = 0 THEN ' ; 距今天约: ' || greatest(0, 2024 * 12 + 6 - (end_ym // 100 * 12 + end_ym % 100)) || ' 个月' ELSE '' END AS text_content,
      row_number() OVER (PARTITION BY user_id ORDER BY end_ym DESC, start_ym DESC, k DESC) AS rank FROM xi JOIN visible USING (file_md5)) WHERE rank <= least(greatest(user_id % 30 - 2, 1), 20)""", EXP)),
    "n05_timeline_answers": (timeline_rows, with_tables("""SELECT user_id AS query_id, rank AS nth, project, period, coalesce(role, '未明确角色') AS role,
      CASE WHEN user_id % 2 = 0 THEN greatest(0, 2024 * 12 + 6 - (end_ym // 100 * 12 + end_ym % 100))::varchar ELSE '' END AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_ym DESC, start_ym DESC, k DESC) AS rank FROM xi JOIN visible USING (file_md5))
      WHERE rank <= least(3, least(greatest(user_id % 30 - 2, 1), 20))""", EXP)),
    "j12_backfill_files": (backfilled, with_tables("SELECT DISTINCT file_md5 FROM chunks WHERE file_md5 NOT IN (SELECT file_md5 FROM xo)", EXP)),
}
