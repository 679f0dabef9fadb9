"""Registered queries: question understanding."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.operators.keywords import default_keywords, intents as intents_by_table, merge_keywords
from marginalia.operators.usage import usage_rows
from marginalia.plans.oracle import has_any, lit, n_hits, rr, sql_list, strip, with_tables
from marginalia.plans.tables import Tables

KW = C.INTENT_KEYWORDS


def _join(c):
    return F.array_join(c, ",")


def terms(t: Tables):
    q = F.col("question")
    return t.questions().select(
        "question_id", _join(Q.query_keywords(q)).alias("keywords"),
        _join(Q.relation_terms(q)).alias("relation_terms"),
        _join(Q.schedule_keywords(q)).alias("schedule_keywords"),
        F.md5(Q.normalize_query(q)).alias("normalized_md5"), Q.top_n(q).alias("top_n"),
    )


def distinct_tokens_sql(name: str, list_expr: str) -> str:
    """Order-preserving distinct of a list per question, as rows (question_id, tok, i)."""
    return f"""SELECT question_id, tok, min(i) AS i FROM (SELECT question_id, unnest(l) AS tok, unnest(range(len(l))) AS i
      FROM (SELECT question_id, {list_expr} AS l FROM questions)) GROUP BY question_id, tok"""


def first_n(source: str, n: int, col: str = "tok") -> str:
    return f"(SELECT coalesce(string_agg({col}, ',' ORDER BY r), '') FROM (SELECT {col}, row_number() OVER (ORDER BY i) AS r FROM {source} x WHERE x.question_id = q.question_id) WHERE r <= {n})"


_NOISE = sql_list(C.RELATION_STOP_TERMS + [h.lower() for h in C.RELATION_QUERY_HINTS])
_SPLIT = r"[\s,()\[\]_/\\:;-]+"
NORMAL = rr(rr(strip("question"), r"[,.!?:;\[\]{}<>\"'`]+", " "), r"\s+", " ")
TERMS_SQL = with_tables(f"""SELECT question_id,
  {first_n('k1', 6)} AS keywords,
  array_to_string(list_filter(list_transform(regexp_split_to_array(question, {lit(_SPLIT)}), lambda x: lower(x)),
    lambda x: x <> '' AND NOT list_contains({_NOISE}, x) AND NOT regexp_matches(x, '^[a-z0-9]$')), ',') AS relation_terms,
  {first_n('k2', 8)} AS schedule_keywords,
  md5({NORMAL}) AS normalized_md5,
  CASE WHEN n = '' THEN 3 ELSE least(n::int, 20) END AS top_n
FROM (SELECT *, regexp_extract(lower(question), '(?:top|latest|recent)?\\s*([1-9]\\d?)', 1) AS n FROM questions) q""", {
    "k1": distinct_tokens_sql("k1", "regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{1,31}')"),
    "k2": distinct_tokens_sql("k2", "regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{1,32}')"),
})


def signals(t: Tables):
    s = t.questions().select("question_id", Q.entity_signals(F.col("question")).alias("s"))
    return s.select("question_id", F.posexplode("s").alias("pos", "e")).select(
        "question_id", "pos", "e.term", "e.entity_type", "e.confidence", "e.source"
    )


_GENERIC = sql_list([w.lower() for w in KW["GENERIC_TOPIC_TERMS"]])
SIGNALS_STEPS = {
    "tok": """SELECT question_id, unnest(l) AS raw, unnest(range(len(l))) AS i FROM (SELECT question_id,
      regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]{2,32}') AS l FROM questions)""",
    "ent": """SELECT question_id, arg_min(term, i) AS term, min(i) AS i FROM (SELECT question_id, i,
      regexp_replace(raw, '[\\s_|-]+', '', 'g') AS term FROM tok) WHERE term <> '' GROUP BY question_id, lower(term)""",
    "cls": f"""SELECT question_id, term, i, CASE WHEN list_contains({_GENERIC}, lower(term)) THEN 0.2::double
      WHEN regexp_matches(term, '^[A-Za-z][A-Za-z0-9_-]{{2,32}}$') OR regexp_matches(term, '^[A-Z]{{2,}}[0-9_-]{{1,16}}$')
      THEN 0.68::double ELSE 0.45::double END AS confidence FROM ent""",
    "sig": """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, i) - 1 AS pos, term,
      CASE WHEN confidence = 0.68::double THEN 'named' ELSE 'topic' END AS entity_type, confidence, 'latin_token' AS source FROM cls""",
}


def anchors(t: Tables):
    q, p = F.col("question"), F.col("profile")
    strong = Q.strong_anchors(q, p)
    return t.questions().select(
        "question_id", _join(Q.anchor_tokens(q, p)).alias("anchors"), _join(strong).alias("strong"), strong.alias("s")
    ).select(
        "question_id", "anchors", "strong",
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("s", Q.anchor_variants)))), ",").alias("variants"),
    )


_IDENT = lit(Q.IDENTIFIER)
_PLAIN = rr(f"lower({strip('question')})", r"[,.!?:;()\[\]{}<>\"'`]+", " ")
ANCHOR_STEPS = {
    "cand": distinct_tokens_sql("cand", f"""list_concat(regexp_extract_all(question, {lit(C.DOTTED_TOKEN)}),
      regexp_extract_all({_PLAIN}, '[A-Za-z][A-Za-z0-9_-]{{1,31}}'))"""),
    "kept": f"""SELECT c.question_id, tok, i, profile FROM cand c JOIN questions USING (question_id)
      WHERE (profile = 'design' AND regexp_matches(tok, {_IDENT}))
      OR NOT (list_contains({sql_list(C.ANCHOR_STOP_WORDS)}, tok)
        OR (profile = 'design' AND list_contains({sql_list(C.DESIGN_STOP_WORDS)}, tok)))""",
    "anch": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS r FROM kept) WHERE r <= 8",
    "stro": f"""SELECT question_id, tok, i FROM anch WHERE (profile = 'design' AND regexp_matches(tok, {_IDENT}))
      OR (NOT list_contains({sql_list(C.STRONG_STOP_WORDS)}, tok)
        AND NOT (profile = 'design' AND list_contains({sql_list(C.DESIGN_STOP_WORDS)}, tok))
        AND regexp_matches(tok, '^[A-Za-z0-9_-]{{3,32}}$'))""",
    "stro4": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS r FROM stro) WHERE r <= 4",
    "stem": """SELECT question_id, tok FROM stro4
      UNION ALL SELECT question_id, left(tok, length(tok) - 6) FROM stro4 WHERE tok LIKE '%screen' AND length(tok) > 6
      UNION ALL SELECT question_id, left(tok, length(tok) - 4) FROM stro4 WHERE tok LIKE '%page' AND length(tok) > 4""",
    "vari": r"""SELECT question_id, tok FROM stem UNION
      SELECT question_id, regexp_replace(lower(tok), '[\s_|-]+', '', 'g') FROM stem""",
}


def intents(t: Tables):
    q = F.col("question")
    i = Q.intent(q)
    return t.questions().select("question_id", "question", "profile", i.alias("intent")).select(
        "question_id", "intent", Q.ask_distance(q).alias("ask_distance"),
        Q.relation_search_wanted(q, F.col("intent")).alias("wants_relation"),
        Q.is_relation_query(q).alias("is_relation"), Q.is_presentation_query(q).alias("is_presentation"),
        Q.is_visual_request(q).alias("is_visual"), Q.evidence_preference(q).alias("preference"),
    )


def intent_sql(e: str) -> str:
    return f"""CASE WHEN {has_any(e, KW['COMPARE_QUERY_KEYS'])} THEN 'compare_query'
      WHEN {has_any(e, KW['STATISTICS_QUERY_KEYS'])} THEN 'statistics_query'
      WHEN {has_any(e, KW['SCHEDULE_QUERY_KEYS'])} THEN 'schedule_query'
      WHEN {n_hits(e, KW['LAYOUT_QUERY_KEYS'])} > 0 AND {n_hits(e, KW['LAYOUT_QUERY_KEYS'])} >= {n_hits(e, KW['FLOW_QUERY_KEYS'])} THEN 'layout_query'
      WHEN {n_hits(e, KW['FLOW_QUERY_KEYS'])} > 0 THEN 'flow_query'
      WHEN {has_any(e, KW['TIMELINE_QUERY_KEYS'])} THEN 'timeline_query' ELSE 'fact_lookup' END"""


def preference_sql(e: str) -> str:
    rel = has_any(e, KW["STRICT_RELATION_KEYS"] + KW["FLOW_QUERY_KEYS"])
    txt = has_any(e, KW["TEXT_EXPLANATION_KEYS"])
    return f"""CASE WHEN {has_any(e, KW['LAYOUT_QUERY_KEYS'])} THEN 'text' WHEN {rel} AND {txt} THEN 'mixed'
      WHEN {rel} THEN 'relation' ELSE 'text' END"""


_STRICT = n_hits("l", KW["STRICT_RELATION_KEYS"])
INTENTS_SQL = with_tables(f"""SELECT question_id, intent, {has_any('l', C.ASK_DISTANCE_KEYS)} AS ask_distance,
  CASE WHEN intent = 'flow_query' THEN {_STRICT} >= 1 ELSE {_STRICT} >= 2 END AS wants_relation,
  {has_any('l', [h.lower() for h in C.RELATION_QUERY_HINTS])} AS is_relation,
  {has_any('l', KW['RELATION_PRESENTATION_KEYS'])} AS is_presentation,
  {has_any('l', KW['VISUAL_DIAGRAM_REQUEST_KEYS'])} AS is_visual, {preference_sql('l')} AS preference
FROM (SELECT question_id, lower(question) AS l, {intent_sql('lower(question)')} AS intent FROM questions)""")


def rewrites(t: Tables):
    q = F.col("question")
    prof = t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS).select(F.col("profile_id").alias("profile"), "query_expand_terms")
    d = t.questions().join(F.broadcast(prof), "profile").select(
        "question_id", "question", "query_expand_terms", Q.intent(q).alias("intent"), Q.entity_signals(q).alias("s")
    )
    r = Q.rewritten_query(q, F.col("intent"), F.col("s"), F.col("query_expand_terms"))
    return d.select("question_id", F.md5(r).alias("rewritten_md5"), F.length(r).alias("n_chars"))


def _expand(base: str) -> str:
    for name, words in (
        ("schedule_query", C.SCHEDULE_EXPANSION), ("layout_query", " ".join(sorted(KW["LAYOUT_QUERY_KEYS"]))),
        ("flow_query", " ".join(sorted(KW["FLOW_QUERY_KEYS"]))),
    ):
        base = f"(CASE WHEN intent = '{name}' THEN {base} || {lit(' ' + words)} ELSE {base} END)"
    return base


REWRITES_SQL = with_tables(f"""SELECT question_id, md5(r) AS rewritten_md5, length(r) AS n_chars FROM (
  SELECT question_id, {strip(_expand('b'))} AS r FROM (SELECT question_id, intent,
    CASE WHEN query_expand_terms <> '' THEN n || ' ' || query_expand_terms ELSE n END AS b
    FROM (SELECT question_id, {intent_sql('lower(question)')} AS intent, {strip(NORMAL)} AS n, query_expand_terms
      FROM questions JOIN profiles ON profile = profile_id)))""")


def keyword_overrides(t: Tables):
    cats = ["COMPARE_QUERY_KEYS", "FLOW_QUERY_KEYS", "NOT_A_CATEGORY"]
    cat = F.element_at(F.array(*[F.lit(c) for c in cats]), (F.col("p_size") % 3 + 1).cast("int"))
    term = F.when(F.col("p_size") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("\n")))
    return merge_keywords(default_keywords(t.spark), t.raw("part").select(cat.alias("category"), term.alias("term")))


def table_intents(t: Tables):
    """All questions by the merged keyword table."""
    return intents_by_table(t.questions().select("question_id", "question"), keyword_overrides(t))


_DEFAULTS = " UNION ALL ".join(
    f"SELECT {lit(c)} AS category, unnest({sql_list(w)}) AS term" for c, w in KW.items() if c != "COMPARE_QUERY_KEYS"
)
_MERGED = f"""SELECT category, term FROM ({_DEFAULTS})
      UNION ALL SELECT DISTINCT 'COMPARE_QUERY_KEYS', lower(p_name) FROM part WHERE p_size % 3 = 0"""


def shaped_usage(t: Tables):
    m = t.raw("conversations").select(
        (F.col("conv_id") % 20).alias("user_id"), F.col("conv_id").alias("conversation_id"),
        F.repeat("text", F.lit(5)).alias("question_text"), F.repeat(F.concat(F.lit("\n"), "text"), F.lit(8)).alias("answer_text"),
        F.when(F.col("turn") == 0, " ").otherwise(F.col("role")).alias("intent"),
        (F.col("turn") - 1).alias("retrieval_count"), F.when(F.col("turn") > 1, " error ").alias("status"),
        F.col("text").alias("error_message"), (F.col("turn") * 100 - 50).alias("latency_ms"), "turn",
    )
    r = usage_rows(m)
    return r.groupBy("user_id", "conversation_id", F.coalesce("intent", F.lit("-")).alias("intent"), "retrieval_count", "status").agg(
        F.sum(F.length("question_text")).alias("q_chars"), F.sum(F.length("answer_text")).alias("a_chars"),
        F.sum(F.length("error_message")).alias("e_chars"), F.sum("latency_ms").alias("latency"),
    )


USAGE_SQL = f"""SELECT conv_id % 20 AS user_id, conv_id::varchar AS conversation_id, CASE WHEN turn = 0 THEN '-' ELSE role END AS intent,
  greatest(turn - 1, 0) AS retrieval_count, CASE WHEN turn > 1 THEN 'error' ELSE 'success' END AS status,
  sum(length(left({strip('repeat(text, 5)')}, 8000)))::bigint AS q_chars,
  sum(length(left({strip('repeat(chr(10) || text, 8)')}, 12000)))::bigint AS a_chars,
  sum(length(left({strip('text')}, 2000)))::bigint AS e_chars, sum(greatest(turn * 100 - 50, 0))::bigint AS latency
FROM conversations GROUP BY ALL"""

QUERIES = {
    "f14_f17_query_terms": (terms, TERMS_SQL),
    "f18_entity_signals": (signals, with_tables("SELECT question_id, pos, term, entity_type, confidence, source FROM sig WHERE pos < 10", SIGNALS_STEPS)),
    "f19_f20_anchors": (anchors, with_tables(
        "SELECT question_id, " + first_n("anch", 8) + " AS anchors, " + first_n("stro4", 4)
        + " AS strong, coalesce((SELECT string_agg(tok, ',' ORDER BY tok) FROM vari v WHERE v.question_id = q.question_id AND tok <> ''), '') AS variants FROM questions q", ANCHOR_STEPS)),
    "n01_n07_intents": (intents, INTENTS_SQL),
    "n02_rewrites": (rewrites, REWRITES_SQL),
    "n03_keyword_overrides": (keyword_overrides, with_tables(_MERGED)),
    "n03_table_intents": (table_intents, with_tables("""SELECT question_id, CASE WHEN c > 0 THEN 'compare_query' WHEN s > 0 THEN 'statistics_query' WHEN p > 0 THEN 'schedule_query'
      WHEN l > 0 AND l >= f THEN 'layout_query' WHEN f > 0 THEN 'flow_query' WHEN t > 0 THEN 'timeline_query' ELSE 'fact_lookup' END AS intent
      FROM (SELECT question_id, count(*) FILTER (category = 'COMPARE_QUERY_KEYS') AS c, count(*) FILTER (category = 'STATISTICS_QUERY_KEYS') AS s, count(*) FILTER (category = 'SCHEDULE_QUERY_KEYS') AS p,
        count(*) FILTER (category = 'LAYOUT_QUERY_KEYS') AS l, count(*) FILTER (category = 'FLOW_QUERY_KEYS') AS f, count(*) FILTER (category = 'TIMELINE_QUERY_KEYS') AS t
        FROM questions LEFT JOIN kt ON contains(lower(trim(question)), term) GROUP BY 1)""", {"kt": _MERGED})),
    "n08_usage_rows": (shaped_usage, USAGE_SQL),
}
