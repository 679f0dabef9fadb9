"""Page-analysis payloads: normalised structure, score, text projection and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import text as X

PAYLOAD = (
    "page_name string, screen_name string, view_name string, page_id string, screen_id string, view_id string, "
    "diagram_type string, diagram_overview string, diagram_summary string, process_description string, "
    "components array<string>, relationships array<string>, keywords array<string>, evidence_texts array<string>, "
    "confidence string, nodes array<struct<name: string>>, "
    "edges array<struct<src: string, dst: string, relation_type: string, confidence: string>>"
)
NO_FLOW = ["該当なし", "なし", "不明"]


def _first(*cols: Column) -> Column:
    return F.coalesce(*[X.blank_to_null(c) for c in cols])


def normalise(analyses: DataFrame) -> DataFrame:
    """payload_json to page identity, nodes, edges and summary; old and new field names.

    Adds page_id, page_name, diagram_type, summary_text, nodes, edges, confidence.
    """
    p = "_p"
    df = analyses.withColumn(p, F.from_json("payload_json", PAYLOAD))
    f = lambda n: F.col(f"{p}.{n}")
    hint_name = F.col("default_page_name") if "default_page_name" in df.columns else F.lit(None).cast("string")
    hint_id = F.col("default_page_id") if "default_page_id" in df.columns else F.lit(None).cast("string")
    name = X.clean_text(F.coalesce(_first(f("page_name"), f("screen_name"), f("view_name"), hint_name), F.lit("unknown")))
    df = df.withColumns({
        "page_name": name,
        "_id": X.clean_text(_first(f("page_id"), f("screen_id"), f("view_id"), hint_id)),
        "diagram_type": F.coalesce(X.blank_to_null(X.clean_text(f("diagram_type"))), F.lit("unknown")),
        "confidence": X.confidence(f("confidence"), 0.65),
        "_components": X.clean_list(f("components"), 50), "_relations": X.clean_list(f("relationships"), 80),
        "_keywords": X.clean_list(f("keywords"), 50), "_evidence": X.clean_list(f("evidence_texts"), 80),
        "_overview": X.clean_text(_first(f("diagram_overview"), f("diagram_summary"))),
        "_process": X.clean_text(f("process_description")),
    })
    df = df.withColumn("page_id", F.coalesce(X.blank_to_null(F.col("_id")), X.fallback_page_id(F.col("page_name"), hint_id)))
    names = F.transform(F.slice(F.coalesce(f("nodes"), F.array().cast("array<struct<name:string>>")), 1, 80), lambda n: X.clean_text(n["name"]))
    nodes = X.keep_first(F.filter(F.concat("_components", names), lambda n: X.node_key(n) != ""), X.node_key)

    def edge(src, dst, rel, conf):
        return F.struct(src.alias("src"), dst.alias("dst"), rel.alias("relation_type"), conf.alias("confidence"))

    given = F.transform(
        F.slice(F.coalesce(f("edges"), F.array().cast("array<struct<src:string,dst:string,relation_type:string,confidence:string>>")), 1, 120),
        lambda e: edge(
            X.clean_text(e["src"]), X.clean_text(e["dst"]),
            F.coalesce(X.blank_to_null(X.clean_text(e["relation_type"])), F.lit(C.CONNECT)),
            X.confidence(e["confidence"], F.col("confidence")),
        ),
    )
    arrow = r"(.+?)\s*(?:->|→|⇒|⇢)\s*(.+)"
    told = F.transform(
        F.filter("_relations", lambda r: r.rlike(arrow)),
        lambda r: edge(
            X.clean_text(F.regexp_extract(r, arrow, 1)), X.clean_text(F.regexp_extract(r, arrow, 2)), F.lit(C.CONNECT), F.lit(0.70)
        ),
    )
    real = F.filter(F.concat(given, told), lambda e: (e["src"] != "") & (e["dst"] != "") & (e["src"] != e["dst"]))
    edges = X.keep_first(real, lambda e: F.struct(X.node_key(e["src"]), X.node_key(e["dst"]), e["relation_type"]))

    def listed(title, arr, n, sep):
        return F.when(F.size(arr) > 0, F.concat(F.lit(title), F.array_join(F.slice(arr, 1, n), sep)))

    flow = F.when((F.col("_process") != "") & ~F.col("_process").isin(NO_FLOW), F.concat(F.lit("処理/流れ: "), "_process"))
    summary = F.concat_ws(
        "\n", F.concat(F.lit("ページID: "), "page_id"), F.concat(F.lit("ページ名: "), "page_name"),
        F.concat(F.lit("図タイプ: "), "diagram_type"), X.blank_to_null(F.col("_overview")),
        listed("主要構成要素: ", F.col("_components"), 20, "、"), flow, listed("関係: ", F.col("_relations"), 20, " / "),
        listed("キーワード: ", F.col("_keywords"), 30, "、"), listed("図中テキスト: ", F.col("_evidence"), 20, " / "),
    )
    df = df.withColumns({"nodes": nodes, "edges": edges, "summary_text": X.clean_text(summary)})
    return df.drop(p, "_id", "_components", "_relations", "_keywords", "_evidence", "_overview", "_process")


def projection(df: DataFrame) -> DataFrame:
    """the analysis as indexable text."""
    def part(title, c):
        return F.when(c != "", F.concat(F.lit(title), c))

    nodes = F.array_join(F.slice("nodes", 1, 20), ", ")
    edges = F.array_join(F.slice(F.transform("edges", lambda e: F.concat(e["src"], F.lit("->"), e["dst"])), 1, 20), "; ")
    text = F.concat_ws(
        "\n", part("page_id=", F.col("page_id")), part("page_name=", F.col("page_name")),
        part("diagram_type=", F.col("diagram_type")), part("summary=", F.col("summary_text")),
        part("nodes=", nodes), part("edges=", edges),
    )
    return df.withColumn("text_projection", X.clean_text(text))


def score(df: DataFrame) -> DataFrame:
    """quality score, tier and flags of an analysis."""
    has_image = F.coalesce(F.col("image_path"), F.lit("")) != ""
    named = (F.col("page_id") != "") | (F.col("page_name") != "")
    summed = F.col("summary_text") != ""
    n, e = F.size("nodes"), F.size("edges")

    def pts(cond, v):
        return F.when(cond, v).otherwise(0)

    total = (
        pts(has_image, 25) + pts(named, 20) + pts(summed, 20) + pts(n > 0, F.least(F.lit(20), n + 5))
        + pts(e > 0, F.least(F.lit(15), e * 2 + 5)) + F.bround(F.col("confidence") * 20).cast("int")
    )
    total = F.least(total, F.lit(100))
    status = (
        F.when(~has_image | (total < 60), "rejected")
        .when((total >= 80) & (summed | (n > 0) | (e > 0)), "accepted").otherwise("weak")
    )
    flags = F.array_compact(F.array(
        F.when(~has_image, "missing_image_path"), F.when(~named, "missing_page_identity"),
        F.when(~summed, "missing_summary"), F.when((n == 0) & (e == 0), "sparse_structure"),
    ))
    return df.withColumns({"quality_score": total, "quality_status": status, "validation_flags": flags})


def to_blocks(df: DataFrame) -> DataFrame:
    """C11: page, summary, projection (unless rejected), at most 100 node and 140 edge blocks per analysis."""
    def block(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    page = block("diagram_page", F.concat(
        F.lit("[diagram_page] page_id="), "page_id", F.lit(" ; page_name="), "page_name", F.lit(" ; diagram_type="), "diagram_type"))
    summary = F.when(F.col("summary_text") != "", block("diagram_summary", F.concat(F.lit("[diagram_summary] "), "summary_text")))
    shown = (F.col("text_projection") != "") & (F.col("quality_status") != "rejected")
    proj = F.when(shown, block("diagram_projection", F.concat(F.lit("[diagram_projection] "), "text_projection")))
    nodes = F.transform(F.slice("nodes", 1, 100), lambda n: block("diagram_node", F.concat(F.lit("[diagram_node] "), n)))
    edges = F.transform(
        F.slice("edges", 1, 140),
        lambda e: block("diagram_edge", F.concat(
            e["src"], F.lit(" -> "), e["dst"], F.lit(" ; rel="), e["relation_type"], F.lit(" ; confidence="),
            F.format_string("%.2f", e["confidence"]))),
    )
    every = F.concat(F.array_compact(F.array(page, summary, proj)), nodes, edges)
    # an inner explode makes Spark filter on the blocks first, which would work out the whole analysis again
    return df.select("file_md5", "image_path", F.posexplode_outer(every).alias("block_no", "b")).filter("b IS NOT NULL").select(
        "file_md5", "image_path", "block_no", "b.type", "b.text", F.lit("vlm_sheet_snapshot").alias("source_parser")
    )
