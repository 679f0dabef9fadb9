"""Registered queries: text, vector, entity, fused and page retrieval."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.operators import acl, evaluation, retrieval as R, vectors as V
from marginalia.plans.joins import lookup_join
from marginalia.plans.oracle import sql_list, with_tables
from marginalia.plans.q_access import users_with_tokens
from marginalia.plans.sequence import top_rows
from marginalia.plans.tables import Tables
from marginalia.session import stored

TOP_K = 10


class Search:
    """The inputs of a retrieval batch, made once per query run."""

    def __init__(self, t: Tables):
        self.t = t
        self.ancestors = acl.tag_ancestors(t.org_tags())
        self.vectors = acl.with_file_tokens(t.chunk_vectors(), self.ancestors)
        self.weights = R.channel_weights(t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS))
        vec = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        self.queries = (
            t.queries().join(users_with_tokens(t).select("user_id", "tokens"), "user_id")
            .join(vec, "query_id", "left")
            .withColumn("entities", Q.entities(Q.entity_signals(F.col("query"))))
        )

    @cached_property
    def chunks(self):
        """The chunk index, built once and read by every channel."""
        none = F.lit(None).cast("string")
        rows = acl.with_file_tokens(self.t.chunks(), self.ancestors).withColumns(
            {"sheet": none, "section": none, "row_order": F.struct("doc_id", "chunk_id")}
        )
        return stored(R.index_columns(rows), "chunk-index")

    @cached_property
    def quality(self):
        """Quality by chunk, with the keys of the index: documents are not cut into chunks again."""
        return self.chunks.select(*R.KEY).join(self.t.chunk_quality(), "file_md5")


def vocabulary(t: Tables):
    return R.vocabulary(t.chunks())


def bm25(t: Tables):
    s = Search(t)
    return R.bm25_channel(s.chunks, s.queries, 40).select("query_id", "file_md5", "chunk_id", "score", "rank")


def parts(t: Tables):
    """Benchmark items and, for the prefix rule, documents short enough for it, as queries."""
    s = Search(t)
    n = F.col("doc_id")
    short = t.raw("documents").filter("length(text) <= 24").select(
        (-n - 1).alias("query_id"), (n % 20 + 1).alias("user_id"), F.col("text").alias("query")
    ).join(users_with_tokens(t).select("user_id", "tokens"), "user_id")
    p = R.text_scores(s.chunks, s.queries.select("query_id", "user_id", "query", "tokens").unionByName(short.select("query_id", "user_id", "query", "tokens")), prefix=True)
    return p.select(
        "query_id", "file_md5", "chunk_id", *[F.round(c, 6).alias(c) for c in ("match", "phrase", "prefix")]
    )


def entity(t: Tables):
    s = Search(t)
    return R.entity_channel(s.chunks, s.queries, 20).select("query_id", "file_md5", "chunk_id", "score", "rank")


def cosine(t: Tables):
    s = Search(t)
    return V.cosine_top(s.vectors, s.queries, 40).select("query_id", "file_md5", "chunk_id", "score", "rank")


def guarded(t: Tables):
    """Every vector against the vector before it; every seventh cut short, every eleventh zero."""
    e = t.raw("embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 10)).when(
        F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)
    ).otherwise(F.col("embedding"))
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), v.alias("b"))
    return a.join(b, "vec_id", "left").select("vec_id", F.round(V.guarded_cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def weights(t: Tables):
    w = R.channel_weights(t.spark.createDataFrame(C.PROFILES, C.PROFILE_FIELDS))
    cols = ["w_vector", "w_bm25", "w_entity", "f_hybrid", "f_relation", "f_visual"]
    q = t.questions().select("question_id", "profile").join(F.broadcast(w), "profile")
    return q.select("question_id", *[F.round(c, 9).alias(c) for c in cols])


def fused(t: Tables):
    s = Search(t)
    ch = {
        "vector": V.cosine_top(s.vectors, s.queries, 40), "bm25": R.bm25_channel(s.chunks, s.queries, 40),
        "entity": R.entity_channel(s.chunks, s.queries, 20),
    }
    f = R.fuse(ch, s.chunks, s.weights, s.queries, 30)
    return f.select("query_id", "file_md5", "chunk_id", "rrf", "final_score", "fused_rank", F.array_join("channels", ",").alias("channels"))


def hybrid(t: Tables):
    s = Search(t)
    h = R.hybrid_search(s.chunks, s.vectors, s.queries, s.quality, s.weights, TOP_K)
    return h.withColumn("text_md5", F.md5("text_content")).drop("text_content")


def keyword(t: Tables):
    s = Search(t)
    k = R.keyword_fallback(s.chunks, s.queries, s.quality, 12)
    return k.select("query_id", "file_md5", "chunk_id", "score", "rank", "quality_status")


def one_pass(t: Tables):
    s = Search(t)
    return R.single_pass(s.chunks, s.vectors, s.queries, TOP_K).select("query_id", "file_md5", "chunk_id", "score", "rank")


def offline(t: Tables):
    return evaluation.retrieval_summary(_case_results(t))


def per_case(t: Tables):
    return _case_results(t).select(
        "case_id", "retrieved", "relevant_in_topk", F.coalesce("first_rel_rank", F.lit(0)).alias("first_rel_rank"),
        "hit_at_k", F.round("mrr", 6).alias("mrr"),
    )


def _case_results(t: Tables):
    s = Search(t)
    best = stored(R.bm25_channel(s.chunks, s.queries, TOP_K), "case-hits")
    hits = lookup_join(s.chunks.select("file_md5", "chunk_id", "text_content", "file_name"), best, ["file_md5", "chunk_id"])
    exp = t.raw("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array(F.md5(F.col("item_id").cast("string"))).alias("file_md5_any"),
        F.array("text").alias("text_contains_any"),
        F.when(F.col("item_id") % 5 == 0, F.lit(9.0)).alias("min_score"),
    )
    j = hits.join(exp, "query_id")
    rel = evaluation.is_relevant(
        {"file_md5": F.col("file_md5"), "file_name": F.col("file_name"), "text_content": F.col("text_content"), "score": F.col("score")},
        {"file_md5_any": F.col("file_md5_any"), "file_name_any": F.lit(None).cast("array<string>"),
         "text_contains_any": F.col("text_contains_any"), "min_score": F.col("min_score")},
    )
    judged = j.select(F.col("query_id").alias("case_id"), "rank", rel.alias("relevant"))
    return evaluation.case_results(t.queries().select(F.col("query_id").alias("case_id")), judged)


def quality_join(t: Tables):
    return R.with_quality(t.chunks().select("file_md5", "chunk_id"), t.child_quality())


def prioritised(t: Tables):
    """Chunks of a file as the hits of one query, in chunk order."""
    hits = t.chunks().select(F.col("user_id").alias("query_id"), "file_md5", "chunk_id", F.struct("doc_id", "chunk_id").alias("pos"))
    return R.prioritise(R.with_quality(hits, t.child_quality()), "pos", 15).select(
        "query_id", "file_md5", "chunk_id", "quality_status", "rank"
    )


def cascade(t: Tables):
    s = Search(t)
    strict = R.bm25_channel(s.chunks, s.queries, 5).filter("score >= 100").select("query_id", "file_md5", "chunk_id", "rank")
    loose = R.entity_channel(s.chunks, s.queries, 5).select("query_id", "file_md5", "chunk_id", "rank")
    return R.fallback(strict, loose)


def supplemented(t: Tables):
    """A question per document; its hits are the two longest chunks of the document (one, where doc_id is odd)."""
    c = t.chunks().select(F.col("doc_id").alias("query_id"), "file_md5", "chunk_id", F.length("text_content").alias("n"))
    hits = top_rows(c, ["query_id"], [F.col("n").desc(), F.col("chunk_id")], 2).filter("rank = 1 OR query_id % 2 = 0")
    return R.supplement(hits.drop("n"), t.chunks().select("file_md5", "chunk_id"))


def embedded(t: Tables):
    """A hashing embedder over every conversation text, in batches of 100."""
    def hashing(texts):
        import zlib
        return [[float(zlib.crc32(w.encode()) % 7) for w in (x[:20], x[-20:], str(len(x)))] for x in texts]

    src = t.raw("conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text")).alias("text"))
    e = V.embed(src, "text", hashing, C.EMBED_BATCH)
    return e.select("conv_id", "turn", F.size("vector").alias("dim"), "embed_status")


def index_rows(t: Tables):
    r = t.chunk_vectors().filter("vector is not null")
    return r.select("file_md5", "chunk_id", "user_id", "org_tag", "is_public", "kb_profile", F.size("vector").alias("dim"))


def page_search(t: Tables):
    from marginalia.operators.pages import best_parent, search_pages

    s = Search(t)
    pages = acl.with_file_tokens(t.visual_pages(), s.ancestors)
    q = s.queries.withColumn("query", F.concat_ws(" ", "query", F.concat(F.lit("sheet_"), (F.col("query_id") % 10).cast("string"))))
    r = search_pages(pages, q, best_parent(t.unit_parents()), 8)
    return r.select("query_id", "file_md5", "chunk_id", "score", "rank", F.md5("text_content").alias("text_md5"))


def page_index(t: Tables):
    from marginalia.operators.pages import index_status

    return index_status(t.visual_pages())


# --- SQL ---------------------------------------------------------------------------------------
W = r"[\p{L}\p{N}_]+"
STEPS = {
    "tk": f"SELECT *, regexp_extract_all(lower(text_content), '{W}') AS l FROM chunks",
    "pst": "SELECT file_md5, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT file_md5, chunk_id, len(l) AS dl, unnest(l) AS term FROM tk) GROUP BY 1, 2, 3",
    "sz": "SELECT count(*) AS n_docs, avg(len(l)) AS avg_dl FROM tk",
    "idf": "SELECT term, ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) AS idf, avg_dl FROM (SELECT term, count(*) AS df FROM pst GROUP BY 1), sz",
}


def query_steps(query_sql: str) -> dict[str, str]:
    return {
        **STEPS,
        "qq": query_sql,
        "ql": f"SELECT *, regexp_extract_all(lower(query), '{W}') AS l FROM qq",
        "qt": """SELECT query_id, user_id, term, any_value(n_terms) AS n_terms, any_value(phrase) AS phrase, any_value(stem) AS stem, any_value(q_len) AS q_len FROM (
          SELECT query_id, user_id, unnest(l) AS term, len(list_distinct(l)) AS n_terms, ' ' || array_to_string(l, '  ') || ' ' AS phrase,
          ' ' || array_to_string(l, '  ') AS stem, length(trim(query)) AS q_len FROM ql) GROUP BY query_id, user_id, term""",
        "qi": "SELECT qt.*, coalesce(idf, 0) AS idf, sum(coalesce(idf, 0)) OVER (PARTITION BY query_id) AS idf_sum FROM qt LEFT JOIN idf USING (term)",
        "mt": """SELECT query_id, file_md5, chunk_id, sum(idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))) AS m, count(*) AS matched,
          any_value(n_terms) AS n_terms, any_value(phrase) AS phrase, any_value(stem) AS stem, any_value(q_len) AS q_len, any_value(idf_sum) AS idf_sum, any_value(dl) AS dl, any_value(avg_dl) AS avg_dl
          FROM qi JOIN pst USING (term) JOIN visible v USING (user_id, file_md5), sz GROUP BY 1, 2, 3""",
        "mp": """SELECT mt.*, (length(b) - length(replace(b, phrase, ''))) / length(phrase)::double AS pf,
          (length(b) - length(replace(b, stem, ''))) / length(stem)::double AS sf
          FROM mt JOIN (SELECT file_md5, chunk_id, ' ' || array_to_string(l, '  ') || ' ' AS b FROM tk) USING (file_md5, chunk_id)""",
        "sc": """SELECT query_id, file_md5, chunk_id, CASE WHEN matched >= greatest(1, n_terms * 6 // 10) THEN m ELSE 0 END AS "match",
          CASE WHEN pf > 0 THEN idf_sum * pf * 2.2::double / (pf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) ELSE 0 END AS phrase,
          CASE WHEN sf > 0 AND q_len <= 24 THEN idf_sum * sf * 2.2::double / (sf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl)) ELSE 0 END AS prefix FROM mp""",
        "et": "SELECT query_id, unnest(x) AS raw, unnest(range(len(x))) AS i FROM (SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{2,32}') AS x FROM qq)",
        "ee": r"SELECT query_id, arg_min(term, i) AS term, min(i) AS i FROM (SELECT query_id, i, regexp_replace(raw, '[\s_|-]+', '', 'g') AS term FROM et) WHERE term <> '' GROUP BY query_id, lower(term)",
        "ec": f"""SELECT query_id, term, i, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_contains({sql_list([w.lower() for w in C.INTENT_KEYWORDS['GENERIC_TOPIC_TERMS']])}, lower(term)) THEN 3
          WHEN regexp_matches(term, '^[A-Za-z][A-Za-z0-9_-]{{2,32}}$') OR regexp_matches(term, '^[A-Z]{{2,}}[0-9_-]{{1,16}}$') THEN 1 ELSE 2 END, i) AS r FROM ee""",
        "ents": "SELECT query_id, term, r FROM ec WHERE r <= 8",
        "kwt": """SELECT query_id, w, min(i) AS i FROM (SELECT query_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (
          SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{1,31}') AS x FROM qq)) GROUP BY query_id, w""",
        "kws": "SELECT query_id, w, i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM kwt) WHERE r <= 6",
        "stm": """SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM (
          SELECT query_id, term, min(o) AS o FROM (SELECT query_id, term, r AS o FROM ents UNION ALL SELECT query_id, w, 100 + i FROM kws
            UNION ALL SELECT query_id, trim(query), 1000000 FROM qq) GROUP BY query_id, term)) WHERE r <= 8""",
        "nm": """SELECT query_id, c.file_md5, c.chunk_id, sum(CASE WHEN c.file_name = s.term THEN 2.6::double ELSE 0 END + CASE WHEN length(s.term) >= 2 AND contains(c.file_name, s.term) THEN 1.25::double ELSE 0 END) AS s
          FROM stm s JOIN qq USING (query_id) JOIN chunks c ON contains(c.file_name, s.term) JOIN visible v ON v.user_id = qq.user_id AND v.file_md5 = c.file_md5 GROUP BY 1, 2, 3""",
        "bmall": """SELECT query_id, file_md5, chunk_id, round(sum(s), 6) AS score FROM (SELECT query_id, file_md5, chunk_id, round("match" + 1.2::double * phrase, 6) AS s FROM sc
          WHERE "match" > 0 OR phrase > 0 UNION ALL SELECT query_id, file_md5, chunk_id, s FROM nm) GROUP BY 1, 2, 3""",
        "bm": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_md5, chunk_id) AS rank FROM bmall) WHERE rank <= 40",
        "enall": """SELECT query_id, file_md5, chunk_id, round(sum(s), 6) AS score FROM (
          SELECT e.query_id, c.file_md5, c.chunk_id, CASE WHEN list_contains(c.l, lower(e.term)) THEN 2.0::double ELSE 0 END
            + CASE WHEN c.file_name = e.term THEN 1.8::double ELSE 0 END + CASE WHEN length(e.term) >= 2 AND contains(c.file_name, e.term) THEN 1.2::double ELSE 0 END AS s
          FROM ents e JOIN qq USING (query_id) JOIN visible v ON v.user_id = qq.user_id JOIN tk c ON c.file_md5 = v.file_md5) WHERE s > 0 GROUP BY 1, 2, 3""",
        "en": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_md5, chunk_id) AS rank FROM enall) WHERE rank <= 20",
        "cs": """SELECT q.query_id, f.file_md5, 0 AS chunk_id, round(list_cosine_similarity(e.embedding::double[], x.embedding::double[]) + 1, 6) AS score
          FROM qq q JOIN embeddings x ON x.vec_id = q.query_id JOIN visible v ON v.user_id = q.user_id JOIN files f ON f.file_md5 = v.file_md5 JOIN embeddings e ON e.vec_id = f.doc_id""",
        "vc": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_md5, chunk_id) AS rank FROM cs) WHERE rank <= 40",
        "chs": "SELECT *, 'vector' AS ch FROM vc UNION ALL SELECT *, 'bm25' FROM bm UNION ALL SELECT *, 'entity' FROM en",
        "wts": """SELECT profile_id AS profile, 0.85::double * w_vector / (w_vector + w_bm25) AS vector, 0.85::double * w_bm25 / (w_vector + w_bm25) AS bm25, 0.15::double AS entity FROM profiles""",
        "rr": """SELECT query_id, file_md5, chunk_id, round(sum(CASE ch WHEN 'vector' THEN vector WHEN 'bm25' THEN bm25 ELSE entity END / (60 + rank)), 12) AS rrf,
          string_agg(ch, ',' ORDER BY ch) AS channels, count(*) AS n_ch, bool_or(ch = 'entity') AS has_en, any_value(qq.profile) AS profile
          FROM chs JOIN qq USING (query_id) JOIN wts USING (profile) GROUP BY 1, 2, 3""",
        "fs": """SELECT rr.*, c.text_content, c.file_name, c.kb_profile, round(rrf + CASE WHEN c.kb_profile = rr.profile THEN 0.12::double ELSE 0 END + CASE WHEN has_en THEN 0.08::double ELSE 0 END
          + CASE WHEN n_ch >= 2 THEN 0.05::double ELSE 0 END
          + CASE WHEN EXISTS (SELECT 1 FROM ents e WHERE e.query_id = rr.query_id AND contains(lower(c.text_content), lower(e.term))) THEN 0.08::double ELSE 0 END, 12) AS final_score
          FROM rr JOIN chunks c USING (file_md5, chunk_id)""",
        "fz": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, file_md5, chunk_id) AS fused_rank FROM fs) WHERE fused_rank <= 30",
        "hy": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN quality_status = 'accepted' THEN 0 ELSE 1 END, fused_rank) AS rank FROM (
          SELECT fz.*, coalesce(q.quality_status, 'weak') AS quality_status FROM fz LEFT JOIN chunk_quality q USING (file_md5)) WHERE quality_status <> 'rejected'""",
    }


def prune(body: str, steps: dict[str, str]) -> str:
    """Keep only the steps a body needs."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, sql in steps.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(sql)
    return with_tables(body, {n: s for n, s in steps.items() if n in need})


QS = query_steps("SELECT * FROM queries")
QS2 = query_steps("SELECT query_id, user_id, query FROM queries UNION ALL SELECT -doc_id - 1, doc_id % 20 + 1, text FROM documents WHERE length(text) <= 24")
QSV = query_steps("SELECT * REPLACE (query || ' sheet_' || (query_id % 10) AS query) FROM queries")
CHUNK = "query_id, file_md5, chunk_id"
PAGE_STEPS = {
    "bp": """SELECT file_md5, document_unit_key, arg_min(text_content, {'s': -quality_score, 'p': parent_chunk_id}) AS parent FROM unit_parents WHERE quality_status IN ('accepted', 'weak') GROUP BY 1, 2""",
    "ft": f"SELECT visual_page_id, fld, bst, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT visual_page_id, fld, bst, len(l) AS dl, unnest(l) AS term FROM (SELECT visual_page_id, 'label' AS fld, 0.35::double AS bst, regexp_extract_all(lower(page_label), '{W}') AS l FROM visual_pages UNION ALL SELECT visual_page_id, 'sheet', 0.30::double, regexp_extract_all(lower(sheet), '{W}') FROM visual_pages)) GROUP BY 1, 2, 3, 4",
    "fdf": "SELECT fld, term, count(*) AS df FROM ft GROUP BY 1, 2",
    "fsz": "SELECT fld, count(DISTINCT visual_page_id) AS n, sum(tf)::double / count(DISTINCT visual_page_id) AS avg_dl FROM ft GROUP BY 1",
    "fm": """SELECT query_id, visual_page_id, sum(bst * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avg_dl))) AS s
      FROM qt JOIN ft USING (term) JOIN fdf USING (fld, term) JOIN fsz USING (fld) GROUP BY 1, 2""",
    "vis": """SELECT p.visual_page_id, q.query_id FROM visual_pages p JOIN qq q ON p.kb_profile = q.profile JOIN users u ON u.user_id = q.user_id
      WHERE p.status = 'indexed' AND p.quality_status IN ('accepted', 'weak') AND (u.role = 'ADMIN' OR p.user_id = u.user_id OR p.is_public OR p.org_tag = 'DEFAULT'
        OR EXISTS (SELECT 1 FROM user_tags t WHERE t.user_id = u.user_id AND t.tag_id = p.org_tag))""",
    "vs": """SELECT query_id, p.*, round(list_cosine_similarity(p.vector::double[], x.embedding::double[]) + 1 + coalesce(s, 0), 9) AS raw FROM vis JOIN visual_pages p USING (visual_page_id)
      JOIN embeddings x ON x.vec_id = query_id LEFT JOIN fm USING (query_id, visual_page_id)""",
    "vr": "SELECT *, round(raw + 0.08::double, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, visual_page_id) AS rank FROM vs",
}
CASE_STEPS = {
    **QS,
    "jd": """SELECT query_id, rank, (file_md5 = md5(query_id::varchar) OR contains(lower(text_content), lower(text))
      OR coalesce(score >= CASE WHEN item_id % 5 = 0 THEN 9.0::double END, false)) AS rel FROM bm JOIN chunks USING (file_md5, chunk_id) JOIN benchmark ON item_id = query_id WHERE rank <= 10""",
    "rs": """SELECT q.query_id AS case_id, count(j.query_id) AS retrieved, count(*) FILTER (rel) AS relevant_in_topk, min(rank) FILTER (rel) AS f
      FROM qq q LEFT JOIN jd j USING (query_id) GROUP BY 1""",
}

QUERIES = {
    "r01_vocabulary": (vocabulary, prune("SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM pst GROUP BY 1", STEPS)),
    "r02_bm25": (bm25, prune(f"SELECT {CHUNK}, score, rank FROM bm", QS)),
    "r03_r04_p06_text_parts": (parts, prune(f"""SELECT {CHUNK}, round("match", 6) AS "match", round(phrase, 6) AS phrase, round(prefix, 6) AS prefix FROM sc
      WHERE "match" > 0 OR phrase > 0 OR prefix > 0""", QS2)),
    "r05_p05_entities": (entity, prune(f"SELECT {CHUNK}, score, rank FROM en", QS)),
    "r06_cosine": (cosine, prune(f"SELECT {CHUNK}, score, rank FROM vc", QS)),
    "r07_x01_guarded_cosine": (guarded, """SELECT a.vec_id, round(CASE WHEN b.vec_id IS NULL OR b.vec_id % 7 = 0 OR b.vec_id % 11 = 0 THEN 0
      ELSE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) END, 6) AS cosine FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1"""),
    "r08_single_pass": (one_pass, prune(f"""SELECT {CHUNK}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_md5, chunk_id) AS rank FROM (
      SELECT {CHUNK}, round(0.7::double * coalesce(c.cosv, 0) + 0.3::double * coalesce("match", 0) + 0.39::double * coalesce(phrase, 0) + 0.21::double * coalesce(prefix, 0), 6) AS score
      FROM (SELECT * FROM sc WHERE "match" > 0 OR phrase > 0 OR prefix > 0) s FULL JOIN (SELECT q.query_id, f.file_md5, 0 AS chunk_id, list_cosine_similarity(e.embedding::double[], x.embedding::double[]) AS cosv
        FROM qq q JOIN embeddings x ON x.vec_id = q.query_id JOIN visible v ON v.user_id = q.user_id JOIN files f ON f.file_md5 = v.file_md5 JOIN embeddings e ON e.vec_id = f.doc_id
        UNION ALL SELECT q.query_id, c.file_md5, c.chunk_id, 0 FROM qq q JOIN visible v ON v.user_id = q.user_id JOIN chunks c ON c.file_md5 = v.file_md5 JOIN files f ON f.file_md5 = v.file_md5
        LEFT JOIN embeddings e ON e.vec_id = f.doc_id AND c.chunk_id = 0 LEFT JOIN embeddings x ON x.vec_id = q.query_id WHERE e.vec_id IS NULL OR x.vec_id IS NULL) c USING (query_id, file_md5, chunk_id))) WHERE rank <= 10""", QS)),
    "r09_channel_weights": (weights, with_tables("""SELECT question_id, round(0.85::double * w_vector / (w_vector + w_bm25), 9) AS w_vector, round(0.85::double * w_bm25 / (w_vector + w_bm25), 9) AS w_bm25,
      0.15::double AS w_entity, round((1 - v) * (w_vector + w_bm25) / (w_vector + w_bm25 + w_relation), 9) AS f_hybrid,
      round((1 - v) * w_relation / (w_vector + w_bm25 + w_relation), 9) AS f_relation, v AS f_visual
      FROM (SELECT *, CASE WHEN profile_id = 'design' THEN 0.18::double ELSE 0.12::double END AS v FROM profiles) p JOIN questions ON profile = profile_id""")),
    "r10_u01_rrf_fuse": (fused, prune(f"SELECT {CHUNK}, rrf, final_score, fused_rank, channels FROM fz", QS)),
    "r11_hybrid_search": (hybrid, prune(f"""SELECT {CHUNK}, rank, round(final_score::decimal(20, 12), 4)::double AS score, file_name, kb_profile, channels, quality_status, md5(text_content) AS text_md5
      FROM hy WHERE rank <= 10""", QS)),
    "r12_p04_keyword_fallback": (keyword, prune(f"""SELECT {CHUNK}, score, quality_status, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN quality_status = 'accepted' THEN 0 ELSE 1 END, pos) AS rank FROM (
        SELECT c.query_id, c.file_md5, c.chunk_id, pos, round(3 + 0.6::double * (SELECT count(*) FROM kws k WHERE k.query_id = c.query_id AND contains(lower(text_content), lower(w)))
          + CASE WHEN kb_profile = profile THEN 0.3::double ELSE 0 END, 4) AS score, coalesce(q.quality_status, 'weak') AS quality_status
        FROM ca c LEFT JOIN chunk_quality q USING (file_md5) WHERE pos <= 12) WHERE quality_status <> 'rejected')""", {**QS,
        "frm": "SELECT query_id, lower(w) AS f FROM kws UNION SELECT query_id, array_to_string(string_split(lower(w), ''), ' ') FROM kws WHERE length(w) <= 6",
        "ca": """SELECT q.query_id, q.profile, c.*, row_number() OVER (PARTITION BY q.query_id ORDER BY doc_id, chunk_id) AS pos
          FROM qq q JOIN visible v ON v.user_id = q.user_id JOIN chunks c ON c.file_md5 = v.file_md5
          WHERE EXISTS (SELECT 1 FROM frm f WHERE f.query_id = q.query_id AND contains(lower(c.text_content), f.f))"""})),
    "r13_p08_j05_page_search": (page_search, prune("""SELECT query_id, file_md5, -visual_page_id AS chunk_id, score, rank,
      md5(coalesce(parent, '[visual_page] label=' || page_label || ' sheet=' || sheet)) AS text_md5
      FROM vr LEFT JOIN bp USING (file_md5, document_unit_key) WHERE rank <= 8""", {**QSV, **PAGE_STEPS})),
    "r18_page_index_status": (page_index, with_tables("""SELECT file_md5, count(*) AS pages, count(*) FILTER (status = 'indexed') AS indexed,
      count(*) FILTER (status LIKE 'pending%') AS pending, 0 AS errors FROM visual_pages GROUP BY 1""")),
    "r17_x02_embed": (embedded, """SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN 3 END AS dim,
      CASE WHEN turn % 5 = 4 THEN 'skipped' ELSE 'indexed' END AS embed_status FROM conversations"""),
    "r19_index_rows": (index_rows, with_tables("""SELECT file_md5, 0 AS chunk_id, user_id, org_tag, is_public, kb_profile, len(embedding) AS dim
      FROM files JOIN embeddings ON vec_id = doc_id""")),
    "a10_offline_metrics": (offline, prune("""SELECT count(*) AS cases, round(avg((f IS NOT NULL)::int), 4) AS hit_at_k, round(avg((f IS NOT NULL)::int), 4) AS recall_at_k,
      round(avg(coalesce(1.0::double / f, 0)), 4) AS mrr, round(avg(f), 4) AS first_rel_rank_avg FROM rs""", CASE_STEPS)),
    "j17_case_results": (per_case, prune("""SELECT case_id, retrieved, relevant_in_topk, coalesce(f, 0) AS first_rel_rank, f IS NOT NULL AS hit_at_k,
      round(coalesce(1.0::double / f, 0), 6) AS mrr FROM rs""", CASE_STEPS)),
    "j03_chunk_quality": (quality_join, with_tables("SELECT file_md5, chunk_id, coalesce(quality_status, 'weak') AS quality_status FROM chunks LEFT JOIN chunk_quality USING (file_md5)")),
    "w03_prioritised": (prioritised, with_tables("""SELECT query_id, file_md5, chunk_id, quality_status, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
      ORDER BY CASE WHEN quality_status = 'accepted' THEN 0 ELSE 1 END, doc_id, chunk_id) AS rank FROM (SELECT c.user_id AS query_id, c.*, coalesce(q.quality_status, 'weak') AS quality_status
      FROM chunks c LEFT JOIN chunk_quality q USING (file_md5)) WHERE quality_status <> 'rejected') WHERE rank <= 15""")),
    "u02_fallback": (cascade, prune(f"""SELECT {CHUNK}, rank FROM bm WHERE rank <= 5 AND score >= 100 UNION ALL
      SELECT {CHUNK}, rank FROM en WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM bm WHERE rank <= 5 AND score >= 100)""", QS)),
    "u03_supplement": (supplemented, with_tables("""SELECT doc_id AS query_id, file_md5, chunk_id, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN hit THEN longest ELSE 3 END, chunk_id) AS rank FROM (
        SELECT *, longest = 1 OR (longest = 2 AND doc_id % 2 = 0) AS hit FROM (SELECT doc_id, file_md5, chunk_id,
          row_number() OVER (PARTITION BY doc_id ORDER BY length(text_content) DESC, chunk_id) AS longest, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS nth FROM chunks))
      WHERE hit OR nth <= 8) WHERE rank <= 8""")),
}
