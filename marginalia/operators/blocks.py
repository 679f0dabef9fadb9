"""Block model: document units, quality scores, parents, children, per-file rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.functions import text as X
from marginalia.plans.sequence import carry_forward, ordered_concat, running_count, top_rows, with_halo


def filled(c: Column) -> Column:
    return X.blank_to_null(X.clean_text(c))


def document_unit(
    file_type: Column, kind: Column, page: Column, sheet: Column, section: Column, block_index: Column
) -> Column:
    """struct(unit_type, unit_key, unit_name, unit_order); sheet and section are null where blank."""
    ft, bt = F.lower(X.strip(F.coalesce(file_type, F.lit("")))), F.lower(X.strip(F.coalesce(kind, F.lit(""))))
    sh, se = sheet, section

    def unit(kind_name, name, order=None, key_name=None):
        key = F.concat(F.lit(f"{kind_name}:"), key_name if key_name is not None else name)
        return F.struct(
            F.lit(kind_name).alias("unit_type"), key.alias("unit_key"), name.alias("unit_name"),
            (order if order is not None else F.lit(None)).cast("int").alias("unit_order"),
        )

    page_text = page.cast("string")
    by_page = unit("page", F.concat(F.lit("page_"), page_text), page, page_text)
    by_section = unit("section", se)
    image_name = F.coalesce(sh, page_text, block_index.cast("string"), F.lit("0"))
    image = unit("image", F.concat(F.lit("image:"), image_name), page, image_name)
    xlsx, pdf, docx = ft.isin(C.XLSX_TYPES), ft == "pdf", ft == "docx"
    return (
        F.when(xlsx & (sh.isNotNull() | se.isNotNull()), unit("sheet", F.coalesce(sh, se)))
        .when((xlsx | pdf) & page.isNotNull(), by_page)
        .when(xlsx, unit("sheet", F.lit("workbook")))
        .when((pdf | docx) & se.isNotNull(), by_section)
        .when(docx, unit("section", F.lit("document")))
        .when(bt.contains("image"), image)
        .otherwise(unit("document", F.lit("root")))
    )


def block_quality(b: dict[str, Column]) -> Column:
    """struct(score, flags) from the parts of a block; text is clean, blank places are null.

    Points are added per rule; `flags` keeps the order: text, locator, image, then the kind's own.
    """
    kind = F.lower(X.strip(F.coalesce(b["type"], F.lit(""))))
    parser = F.lower(X.strip(F.coalesce(b["source_parser"], F.lit(""))))
    text = b["text"]
    has_row = F.coalesce(F.size(b["row_json"]) > 0, F.lit(False))
    row = b["row_json"]
    has_text = text != ""
    located = b["sheet"].isNotNull() | b["section"].isNotNull() | b["page"].isNotNull()
    has_image = b["image_path"].isNotNull()

    def field(name):
        return F.when(has_row, filled(row[name]))

    def pts(cond, n):
        return F.when(cond, n).otherwise(0)

    edge, node, sched = kind == "diagram_edge", kind == "diagram_node", kind == "schedule_row"
    table = kind.contains("table")
    picture = kind.isin("diagram_page", "diagram_summary")
    good_edge = F.coalesce(field("src") != field("dst"), F.lit(False))
    name = F.when(has_row, field("name")).otherwise(
        X.blank_to_null(X.strip(F.regexp_replace(text, r"\A(.*?)\[diagram_node\]", "$1")))
    )
    named = name.isNotNull()
    task = field("task").isNotNull()
    period = field("period_start").isNotNull() & field("period_end").isNotNull()
    n_values = F.when(
        has_row, F.size(F.filter(F.map_values(row), lambda v: X.clean_text(v) != ""))
    ).otherwise(0)

    own = (
        F.when(edge, pts(good_edge, 28))
        .when(node, pts(named, 22))
        .when(sched, pts(task, 10) + pts(period, 15))
        .when(table, F.when(n_values >= 2, 25).when(n_values == 1, 8).otherwise(0))
        .when(picture, pts(has_image, 15) + pts(has_text, 10))
        .otherwise(pts(has_text, 10) + pts(located, 8))
    )
    raw = (
        pts(has_text, 18) + pts(has_text & (F.length(text) >= 8), 7) + pts(located, 16)
        + pts(has_image, 9) + pts(has_row, 14) + own
    )
    unbound = ~has_image & (parser.isin(C.VISION_PARSERS) | kind.contains("image"))
    bad_edge = edge & ~good_edge
    score = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    score = F.when(unbound, F.least(score, F.lit(C.MISSING_IMAGE_CAP))).otherwise(score)
    score = F.when(bad_edge | ~has_text, F.least(score, F.lit(C.INVALID_CAP))).otherwise(score)
    only_table = table & ~(edge | node | sched)
    flags = F.array_compact(F.array(
        F.when(~has_text, "empty_text"),
        F.when(~located, "missing_locator"),
        F.when(unbound, "missing_image_binding"),
        F.when(bad_edge, "invalid_edge"),
        F.when(node & ~named, "missing_node_name"),
        F.when(sched & ~task, "missing_schedule_task"),
        F.when(sched & ~period, "missing_schedule_period"),
        F.when(only_table & (n_values == 1), "sparse_table_row"),
        F.when(only_table & (n_values == 0), "empty_table_row"),
    ))
    return F.struct(score.cast("int").alias("score"), flags.alias("flags"))


def enrich(blocks: DataFrame) -> DataFrame:
    """Unit and quality columns for every block; no shuffle.

    Texts are cleaned once, in a projection of their own, because the rules use them many times.
    """
    c = F.col
    tidy = blocks.withColumns({
        "_text": X.clean_text(c("text")), "_sheet": filled(c("sheet")), "_section": filled(c("section")),
        "_image": filled(c("image_path")),
    })
    unit = document_unit(c("file_type"), c("type"), c("page"), c("_sheet"), c("_section"), c("block_index"))
    quality = block_quality({
        "type": c("type"), "source_parser": c("source_parser"), "text": c("_text"), "row_json": c("row_json"),
        "sheet": c("_sheet"), "section": c("_section"), "page": c("page"), "image_path": c("_image"),
    })
    scored = tidy.withColumns({"_u": unit, "_q": quality}).select(
        *blocks.columns,
        *[c(f"_u.{n}").alias(f"document_{n}") for n in ("unit_type", "unit_key", "unit_name", "unit_order")],
        c("_q.score").alias("quality_score"), c("_q.flags").alias("validation_flags"),
    )
    return scored.withColumns({"quality_status": X.quality_tier(c("quality_score")), "parser_confidence": c("quality_score")})


def parent_chunks(blocks: DataFrame) -> DataFrame:
    """One row per document unit with text, in order of first appearance."""
    keys = ["file_md5", "document_unit_key"]
    text = X.clean_text(F.col("text"))
    stats = blocks.groupBy(*keys).agg(
        F.min("block_index").alias("first_block"),
        F.min_by("document_unit_type", "block_index").alias("document_unit_type"),
        F.min_by("document_unit_name", "block_index").alias("document_unit_name"),
        F.bround(F.avg("quality_score")).cast("int").alias("quality_score"),
        F.when(F.bool_or(F.col("quality_status").isin("rejected", "weak")), "weak").otherwise("accepted").alias(
            "quality_status"
        ),
        F.array_sort(F.collect_set(X.blank_to_null(F.col("source_parser")))).alias("source_parsers"),
    )
    numbered = running_count(stats, ["file_md5"], "first_block", F.lit(1), "_nth")
    body = ordered_concat(blocks.filter(text != ""), keys, "block_index", text, "\n\n", "joined")
    indexes = ordered_concat(
        blocks, keys, "block_index", F.col("block_index").cast("string"), ",", "block_indexes"
    )
    return (
        numbered.join(body, keys).join(indexes, keys)
        .select(
            *keys, (F.col("_nth") - 1).alias("parent_chunk_id"),
            F.concat("document_unit_type", F.lit("_context")).alias("chunk_type"),
            X.clean_text(F.col("joined")).alias("text_content"), "quality_score", "quality_status",
            "document_unit_type", "document_unit_name", "block_indexes", "source_parsers",
        )
    )


def child_chunks(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks with their parent and the sibling before and after."""
    p = parents.select(
        "file_md5", "document_unit_key", "parent_chunk_id",
        F.col("quality_score").alias("_ps"), F.col("quality_status").alias("_pq"),
    )
    linked = (
        chunks.withColumn("document_unit_key", F.coalesce("document_unit_key", F.lit("document:root")))
        .join(p, ["file_md5", "document_unit_key"], "left")
        .withColumn("quality_score", F.coalesce(F.nullif("quality_score", F.lit(0)), "_ps", F.lit(0)))
        .withColumn("quality_status", F.coalesce("quality_status", "_pq", F.lit("weak")))
        .drop("_ps", "_pq")
    )
    return sibling_links(linked)


def sibling_links(chunks: DataFrame) -> DataFrame:
    """Previous and next chunk id where the parent is the same (null equals null)."""
    w = W.partitionBy("file_md5", "seg").orderBy("chunk_id")

    def neighbour(fn):
        near = fn(F.struct("chunk_id", "parent_chunk_id")).over(w)
        same = near["parent_chunk_id"].eqNullSafe(F.col("parent_chunk_id"))
        return F.when(near.isNotNull() & same, near["chunk_id"])

    return (
        with_halo(chunks, "chunk_id", 1, 1)
        .withColumn("neighbor_prev_id", neighbour(F.lag))
        .withColumn("neighbor_next_id", neighbour(F.lead))
        .filter("own").drop("own", "seg")
    )


def quality_by_file(blocks: DataFrame) -> DataFrame:
    """A02."""
    return blocks.groupBy("file_md5").agg(
        F.count("*").alias("blocks"),
        *[F.count_if(F.col("quality_status") == s).alias(s) for s in ("accepted", "weak", "rejected")],
        F.sum("quality_score").alias("score_sum"),
    )


def parser_counts(sources: DataFrame) -> DataFrame:
    """A21."""
    name = F.coalesce(X.blank_to_null(F.col("source_parser")), F.lit("unknown"))
    return sources.groupBy("file_md5", name.alias("source_parser")).agg(F.count("*").alias("n"))


def router_quality(blocks: DataFrame) -> DataFrame:
    """Per-file counts that decide whether pages need a closer look."""
    n = F.length(X.clean_text(F.col("text")))
    kind = F.coalesce("type", F.lit(""))
    out = blocks.groupBy("file_md5").agg(
        F.first("file_type").alias("file_type"),
        F.count_if(n > 0).alias("text_blocks"), F.sum(n.cast("long")).alias("total_chars"),
        *[F.count_if(kind.contains(k)).alias(f"{k}_like") for k in ("table", "schedule", "diagram", "image")],
    )
    avg = F.when(F.col("text_blocks") > 0, F.col("total_chars") / F.col("text_blocks")).otherwise(0.0)
    return out.withColumn("avg_chars", avg)


def route_flags(
    quality: DataFrame, media: Column, profile: Column, visual_sheets: Column, vision: bool = True
) -> DataFrame:
    """Escalate to page images, and use page analysis, from router_quality rows."""
    c = F.col
    xlsx, docx = c("file_type").isin(C.XLSX_TYPES), c("file_type") == "docx"
    weak = (c("total_chars") < 1200) | (c("avg_chars") < 40)
    escalate = (xlsx | docx) & (weak | ((media >= 2) & (c("schedule_like") == 0)))
    signal = xlsx & (visual_sheets | (c("diagram_like") > 0) | (c("image_like") > 0))
    structured = c("table_like") + c("schedule_like") + c("diagram_like")
    points = (
        F.when(weak, 2).otherwise(0) + F.when(docx & (media >= 2), 1).otherwise(0)
        + F.when(structured < 2, 1).otherwise(0) + F.when(profile.isin("design", "ops"), 1).otherwise(0)
    )
    analyse = (
        F.when(~(xlsx | docx) | (docx & (media <= 0)), False)
        .when(signal | (docx & (c("total_chars") < 1500)), True)
        .otherwise(points >= 2)
    )
    return quality.withColumn("escalate", escalate).withColumn("analyse_pages", analyse & F.lit(vision))


def table_rows(blocks: DataFrame) -> DataFrame:
    """Rows of table and schedule blocks, from the map or from 'k: v ; k: v' text."""
    kind = F.coalesce("type", F.lit(""))
    row = F.when(F.size("row_json") > 0, F.col("row_json")).otherwise(X.pairs_to_map(F.col("text")))
    return (
        blocks.filter(kind.contains("table") | (kind == "schedule_row"))
        .withColumn("row_json", row).filter(F.size("row_json") > 0)
        .select(
            "file_md5", "sheet", F.col("sheet").alias("table_name"),
            F.col("row_no").try_cast("int").alias("row_no"), "row_json",
            X.clean_text(F.col("text")).alias("raw_text"),
            F.coalesce("source_parser", F.lit("table")).alias("source_parser"),
        )
    )


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def relation_gate(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Which files get a relation index."""
    is_diagram = F.coalesce("type", F.lit("")).isin("diagram_edge", "diagram_node", "diagram_page") | (
        F.coalesce("source_parser", F.lit("")) == "xlsx_diagram"
    )
    lines = blocks.select("file_md5", is_diagram.alias("diagram"), F.explode(split_lines(F.col("text"))).alias("l"))
    line = X.strip(F.col("l"))
    low = F.lower(line)
    words = [w.lower() for ws in C.RELATION_KEYWORDS.values() for w in ws]
    stats = lines.groupBy("file_md5").agg(
        F.bool_or("diagram").alias("diagram"), F.count_if(line != "").alias("n"),
        F.count_if(F.length(line).between(1, 28)).alias("short"),
        F.count_if(Q.any_contained(low, words)).alias("words"),
        F.count_if(Q.any_contained(low, C.ARROWS)).alias("arrows"),
    )
    signals = (
        F.coalesce(F.try_divide("short", "n") > 0.35, F.lit(False)).cast("int")
        + (F.col("words") >= 3).cast("int") + (F.col("arrows") >= 1).cast("int")
    )
    hinted = Q.any_contained(F.lower("file_name"), [h.lower() for h in C.RELATION_DOC_HINTS])
    joined = files.select("file_md5", "file_name").join(stats, "file_md5", "left")
    return joined.select(
        "file_md5",
        (hinted | F.coalesce("diagram", F.lit(False)) | F.coalesce(signals >= 2, F.lit(False))).alias("build"),
    )


def page_routing(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Text quality per page, no-text streak, weak-page ratio and the recognition budget.

    `pages` has file_md5, page (1..n), text, kb_profile. The ratio is an aggregate joined back and
    the budget a per-file top-n, so no task has to see a whole file.
    """
    q = X.page_text_quality(X.clean_text(F.col("text")))
    p = pages.withColumn("q", q).select(
        "file_md5", "page", "kb_profile", F.col("q.chars").alias("chars"), F.col("q.words").alias("words"),
        F.col("q.valid_ratio").alias("valid_ratio"),
    )
    p = carry_forward(p, ["file_md5"], "page", F.when(F.col("chars") > 0, F.col("page")), "_last")
    p = p.withColumn("no_text_streak", F.col("page") - F.coalesce("_last", F.lit(0))).drop("_last")
    p = p.join(F.broadcast(profiles), F.col("kb_profile") == F.col("profile_id"))
    weak = (
        (F.col("chars") < F.col("ocr_min_chars")) | (F.col("words") < F.col("ocr_min_words"))
        | (F.col("valid_ratio") < F.col("ocr_min_valid_ratio"))
        | (F.col("no_text_streak") >= F.col("ocr_no_text_streak"))
    )
    p = p.withColumn("weak", weak)
    ratio = p.groupBy("file_md5").agg(F.avg(F.col("weak").cast("double")).alias("weak_ratio"))
    p = p.join(ratio, "file_md5").withColumn("forced", F.col("weak_ratio") >= F.col("ocr_doc_trigger_ratio"))
    p = p.withColumn("wants_ocr", F.col("forced") | F.col("weak"))
    budget = profiles.agg(F.max("ocr_max_pages")).first()[0]
    chosen = top_rows(p.filter("wants_ocr"), ["file_md5"], [F.col("page")], F.col("ocr_max_pages"), "_r", budget)
    chosen = chosen.select("file_md5", "page", F.lit(True).alias("ocr"))
    return (
        p.join(chosen, ["file_md5", "page"], "left")
        .select("file_md5", "page", "chars", "words", "no_text_streak", "weak", "weak_ratio", "forced",
                F.coalesce("ocr", F.lit(False)).alias("ocr"))
    )


def carry_sections(paragraphs: DataFrame) -> DataFrame:
    """Every paragraph gets the last heading above it (first 120 characters)."""
    heading = F.when(F.lower("style").startswith("heading"), F.left("text", F.lit(120)))
    return carry_forward(paragraphs, ["file_md5"], "position", heading, "section")


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """Provenance rows of a chunk; page-analysis sources need an image, own or the chunk's."""
    rows = chunks.select(
        "file_md5", "chunk_id", F.col("image_path").alias("_chunk_image"),
        F.posexplode("sources").alias("source_order", "s"),
    )
    image = F.coalesce(filled(F.col("s.image_path")), filled(F.col("_chunk_image")))
    vision = F.coalesce("s.source_parser", F.lit("")).isin(C.VISION_PARSERS)
    return rows.filter(~vision | image.isNotNull()).select(
        "file_md5", "chunk_id", "source_order", "s.block_index", "s.source_type", "s.source_parser",
        "s.sheet", "s.page", "s.section",
        F.when(vision, image).otherwise(F.col("s.image_path")).alias("image_path"),
        F.left(X.clean_preview(F.col("s.text_preview"), F.col("s.source_type")), F.lit(C.PREVIEW_CHARS)).alias(
            "text_preview"
        ),
    )
