"""Sheet cells: header rows, row blocks, schedules, page matching, drawing graphs.

Cells are long-form rows (file_md5, sheet, row, col, value, fill_sig). Groups are sheets, rows of
a sheet or columns of a sheet; a spreadsheet row has at most 16,384 columns, so a window inside
one row is bounded by the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import text as X
from marginalia.plans.joins import MANY_TERMS, contained_terms, is_small, lookup_join
from marginalia.plans.sequence import top_rows, with_halo
from marginalia.session import stored

SHEET = ["file_md5", "sheet"]


def header_rows(cells: DataFrame, scan_rows: int = 25) -> DataFrame:
    """The row that looks most like a header among the first rows; the first best one wins."""
    v = X.clean_text(F.col("value"))
    near = cells.filter(F.col("row") <= scan_rows).withColumn("v", v).filter("v <> ''")
    textual = F.col("v").rlike(f"[{C.CJK}A-Za-z]")
    numeric = ~textual & F.col("v").rlike(r"\A[-+]?\d+(?:[.,]\d+)?\z")
    hinted = X.any_contained(F.lower("v"), C.HEADER_HINTS)
    rows = near.groupBy(*SHEET, "row").agg(
        F.count("*").alias("n"), F.count_distinct("v").alias("u"), F.count_if(textual).alias("t"),
        F.count_if(hinted).alias("h"), F.count_if(numeric).alias("d"),
    )
    c = F.col
    score = F.round(c("n") * 1.6 + c("u") * 0.5 + c("t") * 1.2 + c("h") * 2.0 - c("d") * 0.9, 6)
    return rows.filter("n >= 2").groupBy(*SHEET).agg(
        F.max_by("row", F.struct(score, -F.col("row"))).alias("header_row"), F.max(score).alias("header_score")
    )


def row_blocks(cells: DataFrame) -> DataFrame:
    """One block per non-empty row from the header on: header labels, then 'label: value' pairs."""
    v = X.clean_text(F.col("value"))
    full = cells.withColumn("v", v)
    filled = full.filter("v <> ''")
    shape = full.groupBy(*SHEET).agg(F.max("col").alias("width")).join(
        filled.groupBy(*SHEET).agg(F.min("row").alias("first_row")), SHEET
    )
    shape = shape.join(header_rows(cells), SHEET, "left").withColumn(
        "header", F.coalesce("header_row", "first_row")
    ).select(*SHEET, "width", "header")
    placed = filled.join(shape, SHEET).filter(F.col("row") >= F.col("header"))
    labels = placed.filter("row = header").select(*SHEET, "col", F.col("v").alias("label"))
    named = placed.join(labels, [*SHEET, "col"], "left").withColumn(
        "label", F.coalesce("label", F.concat(F.lit("col_"), F.col("col").cast("string")))
    )
    pair = F.struct("col", "label", "v")
    rows = named.groupBy(*SHEET, "row", "header", "width").agg(F.array_sort(F.collect_list(pair)).alias("a"))
    is_header = F.col("row") == F.col("header")
    values = F.map_from_entries(F.transform("a", lambda p: F.struct(p["col"], p["v"])))
    every = F.sequence(F.lit(1), F.col("width"))
    column = lambda i: F.concat(F.lit("col_"), i.cast("string"))
    header_text = F.array_join(F.transform(every, lambda i: F.coalesce(values[i], column(i))), " | ")
    header_map = F.map_from_entries(F.transform(every, lambda i: F.struct(column(i), F.coalesce(values[i], F.lit("")))))
    row_text = F.array_join(F.transform("a", lambda p: F.concat(p["label"], F.lit(": "), p["v"])), " ; ")
    # a label may head several columns: the last value wins, as in a dictionary
    last = F.reverse(X.keep_first(F.reverse(F.transform("a", lambda p: F.struct(p["label"], p["v"]))), lambda p: p["label"]))
    return rows.select(
        *SHEET, F.col("row").alias("row_no"), F.when(is_header, "table_header").otherwise("table_row").alias("type"),
        F.when(is_header, header_text).otherwise(row_text).alias("text"),
        F.when(is_header, header_map).otherwise(F.map_from_entries(last)).alias("row_json"),
    )


def timeline_rows(cells: DataFrame, header_limit: int = 15) -> DataFrame:
    """Per sheet the year row, the month row and the week row (the last numeric one)."""
    v = X.clean_text(F.col("value"))
    head = cells.filter(F.col("row") <= header_limit).groupBy(*SHEET, "row").agg(
        F.count_if(v.rlike(r"\A\d{4}\z")).alias("years"), F.count_if(v.rlike(r"\A\d{1,2}\z")).alias("nums")
    )
    numeric = F.when(F.col("nums") >= 6, F.col("row"))
    tall = cells.groupBy(*SHEET).agg(F.max("row").alias("_rows"), F.max("col").alias("_cols")).filter("_rows > 5 and _cols > 5")
    found = head.join(tall.select(*SHEET), SHEET, "left_semi").groupBy(*SHEET).agg(
        F.min(F.when(F.col("years") >= 1, F.col("row"))).alias("year_row"),
        F.array_sort(F.collect_set(numeric)).alias("rows"),
    ).filter(F.size("rows") > 0)
    n = F.size("rows")
    return found.select(
        *SHEET, "year_row", F.element_at("rows", -1).alias("week_row"),
        F.when(n > 1, F.element_at("rows", n - 1)).alias("month_row"),
    )


def timeline_columns(cells: DataFrame, rows: DataFrame, min_columns: int = 8) -> DataFrame:
    """Timeline columns with their forward-filled label `Y-M月-Ww`."""
    v = X.clean_text(F.col("value"))
    head = cells.withColumn("v", v).join(rows, SHEET)

    def at(name):
        return F.max(F.when(F.col("row") == F.col(name), F.nullif("v", F.lit("")))).alias(name[0])

    cols = head.filter("row = year_row or row = month_row or row = week_row").groupBy(*SHEET, "col").agg(
        at("year_row"), at("month_row"), at("week_row")
    )

    cols = cols.filter(F.coalesce(F.col("m").rlike(r"\A\d{1,2}\z"), F.lit(False)) | F.coalesce(F.col("w").rlike(r"\A\d{1,2}\z"), F.lit(False)))
    upto = W.partitionBy(*SHEET).orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    year, month = F.last("y", ignorenulls=True).over(upto), F.last("m", ignorenulls=True).over(upto)
    label = F.concat_ws("-", year, F.concat(month, F.lit("月")), F.concat(F.lit("W"), F.col("w")))
    cols = cols.withColumn("label", F.when(label == "", F.concat(F.lit("C"), F.col("col"))).otherwise(label))
    spans = cols.groupBy(*SHEET).agg(
        F.count("*").alias("n_cols"), F.min("col").alias("first_col"), F.max("col").alias("last_col")
    ).filter((F.col("n_cols") >= min_columns) & (F.col("first_col") > 1))
    return cols.select(*SHEET, "col", "label").join(spans, SHEET)


def _tasks(cells: DataFrame, rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Task name and detail per data row, from the text left of the timeline."""
    v = X.clean_text(F.col("value"))
    left = cells.withColumn("v", v).filter("v <> ''").join(rows, SHEET).join(spans, SHEET)
    left = left.filter((F.col("row") > F.col("week_row")) & (F.col("col") < F.least("first_col", F.lit(10))))
    texts = left.groupBy(*SHEET, "row", "year_row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("a"))
    return texts.select(
        *SHEET, "row", "year_row", F.element_at("a", 1)["v"].alias("task"),
        F.array_join(F.slice(F.col("a.v"), 2, 3), " / ").alias("detail"),
    )


def background_fills(cells: DataFrame, tasks: DataFrame, columns: DataFrame) -> DataFrame:
    """How often each fill occurs on the timeline of task rows; frequent fills are background.

    A lone fill on over 35 % of the cells is covered by the 12 % rule.
    """
    spans = columns.select(*SHEET, "n_cols").distinct()
    total = tasks.groupBy(*SHEET).agg(F.count("*").alias("n_rows")).join(spans, SHEET)
    used = cells.filter(F.coalesce("fill_sig", F.lit("")) != "").join(tasks.select(*SHEET, "row"), [*SHEET, "row"]).join(
        columns.select(*SHEET, "col"), [*SHEET, "col"]
    )
    counted = used.groupBy(*SHEET, "fill_sig").agg(F.count("*").alias("n")).join(total, SHEET)
    return counted.select(*SHEET, "fill_sig", "n", (F.col("n") / (F.col("n_rows") * F.col("n_cols")) >= 0.12).alias("background"))


def longest_runs(cells: DataFrame) -> DataFrame:
    """Per row the longest run of neighbouring columns with one fill.

    Ties go to the fill seen first in the row, then to the earliest run.
    """
    w = W.partitionBy(*SHEET, "row", "fill_sig").orderBy("col")
    runs = cells.withColumn("_island", F.col("col") - F.row_number().over(w)).groupBy(
        *SHEET, "row", "fill_sig", "_island"
    ).agg(F.min("col").alias("start_col"), F.max("col").alias("end_col"), F.count("*").alias("len"))
    seen = F.min("start_col").over(W.partitionBy(*SHEET, "row", "fill_sig"))
    runs = runs.withColumn("seen", seen)
    best = F.max_by(
        F.struct("fill_sig", "start_col", "end_col", "len"), F.struct("len", -F.col("seen"), -F.col("start_col"))
    )
    return runs.groupBy(*SHEET, "row").agg(best.alias("b")).select(*SHEET, "row", "b.*")


def _labelled(found: DataFrame, columns: DataFrame) -> DataFrame:
    for side in ("start", "end"):
        lab = columns.select(*SHEET, F.col("col").alias(f"{side}_col"), F.col("label").alias(f"{side}_label"))
        found = found.join(lab, [*SHEET, f"{side}_col"], "left").withColumn(
            f"{side}_label", F.coalesce(f"{side}_label", F.concat(F.lit("C"), F.col(f"{side}_col")))
        )
    return found


def schedule_rows(cells: DataFrame) -> DataFrame:
    """W05, all steps: schedule rows of sheets whose cells are filled along a timeline.

    The row and column caps of a single-file parser only protect it and are not applied.
    """
    rows = timeline_rows(cells)
    columns = timeline_columns(cells, rows)
    tasks = _tasks(cells, rows, columns.select(*SHEET, "first_col").distinct())
    fills = background_fills(cells, tasks, columns)
    filled = F.coalesce("filled", F.lit(True)) if "filled" in cells.columns else F.lit(True)
    usable = (
        cells.withColumn("_filled", filled).join(tasks.select(*SHEET, "row"), [*SHEET, "row"])
        .join(columns.select(*SHEET, "col"), [*SHEET, "col"])
        .join(fills, [*SHEET, "fill_sig"]).filter(~F.col("background") & ((F.col("n") >= 2) | F.col("_filled")))
    )
    runs = longest_runs(usable.select(*SHEET, "row", "col", "fill_sig")).filter("len >= 2")
    found = _labelled(runs.join(tasks, [*SHEET, "row"]), columns)
    conf = (
        0.40 + F.when(F.col("year_row").isNotNull(), 0.20).otherwise(0.0) + F.when(F.col("len") >= 3, 0.18).otherwise(0.0)
        + F.when(F.length("task") >= 2, 0.12).otherwise(0.0) + F.when(F.col("detail") != "", 0.08).otherwise(0.0)
    )
    return found.select(
        *SHEET, F.col("row").alias("row_no"), "task", "detail", "start_col", "end_col", "start_label", "end_label",
        F.round(F.least(conf, F.lit(0.98)), 2).alias("confidence"),
    )


def schedule_from_anchors(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Schedule rows from drawn bars (row, start_col, end_col), clipped; the widest per row."""
    rows = timeline_rows(cells)
    columns = timeline_columns(cells, rows)
    spans = columns.select(*SHEET, "first_col", "last_col").distinct()
    tasks = _tasks(cells, rows, spans)
    bars = anchors.join(spans, SHEET).filter("end_col >= first_col and start_col <= last_col")
    bars = bars.withColumn("start_col", F.greatest("start_col", "first_col")).withColumn(
        "end_col", F.least("end_col", "last_col")
    ).filter("end_col > start_col")
    widest = F.struct(F.col("end_col") - F.col("start_col"), -F.col("anchor_no"))
    best = bars.groupBy(*SHEET, "row").agg(F.max_by(F.struct("start_col", "end_col"), widest).alias("b")).select(*SHEET, "row", "b.*")
    found = _labelled(best.join(tasks, [*SHEET, "row"]), columns)
    return found.select(
        *SHEET, F.col("row").alias("row_no"), "task", "detail", "start_col", "end_col", "start_label", "end_label",
        F.lit(0.82).alias("confidence"),
    )


def schedule_blocks(rows: DataFrame) -> DataFrame:
    """Schedule rows as text blocks."""
    detail = F.when(F.col("detail") != "", F.concat(F.lit(" ; detail="), F.left("detail", F.lit(240)))).otherwise("")
    text = F.concat(
        F.lit("[schedule] sheet="), "sheet", F.lit(" ; task="), "task", F.lit(" ; period="), "start_label",
        F.lit(" -> "), "end_label", detail, F.lit(" ; confidence="), F.format_string("%.2f", "confidence"),
    )
    fields = {
        "task": "task", "period_start": "start_label", "period_end": "end_label", "period_start_col": "start_col",
        "period_end_col": "end_col", "task_detail": "detail", "confidence": "confidence",
    }
    row = F.map_from_arrays(
        F.array(*[F.lit(k) for k in fields]), F.array(*[F.col(c).cast("string") for c in fields.values()])
    )
    return rows.select(
        *SHEET, "row_no", F.lit("schedule_row").alias("type"), text.alias("text"), row.alias("row_json"),
        F.lit("xlsx_schedule").alias("source_parser"),
    )


def sheet_statistics(blocks: DataFrame, limits: dict | None = None) -> DataFrame:
    """Which sheets look like diagrams rather than tables."""
    lim = {**C.SNAPSHOT, **(limits or {})}
    rows = blocks.filter(X.strip(F.coalesce("sheet", F.lit(""))) != "").withColumn("t", X.clean_text(F.col("text")))
    toks = F.regexp_extract_all("t", F.lit(f"([{C.CJK}A-Za-z0-9]{{2,24}})"), F.lit(1))
    cells = F.when(F.size("row_json") > 0, F.size(F.filter(F.map_values("row_json"), lambda v: X.clean_text(v) != ""))).otherwise(0)
    stats = rows.groupBy(*SHEET).agg(
        F.count_if(F.col("type") == "diagram_edge").alias("edges"), F.count_if(F.col("type") == "diagram_node").alias("nodes"),
        F.count_if(F.col("type").isin("table_row", "table_header", "schedule_row")).alias("table_rows"),
        F.sum(F.length("t")).alias("chars"), F.sum(F.size(toks)).alias("tokens"),
        (F.count_if(F.col("t") != "") + F.sum(cells)).alias("cells"),
    )
    distinct = rows.select(*SHEET, F.explode(F.array_distinct(F.transform(toks, lambda x: F.lower(x)))).alias("w")).distinct()
    stats = stats.join(distinct.groupBy(*SHEET).agg(F.count("*").alias("distinct_tokens")), SHEET, "left").fillna(0, ["distinct_tokens"])
    c = F.col
    per_cell = F.coalesce(F.try_divide(c("chars"), c("cells")), F.lit(9999.0))
    sparse = (
        (c("cells") >= lim["low_cells_min"]) & (c("chars") <= lim["low_chars_max"]) & (c("tokens") <= lim["low_token_max"])
        & (per_cell <= lim["low_char_per_cell"]) & (c("distinct_tokens") <= lim["low_distinct_max"]) & (c("table_rows") <= 2)
    )
    graph = ((c("edges") >= 1) & (c("nodes") >= 2)) | (c("nodes") >= lim["node_threshold"])
    return stats.withColumn("candidate", graph | sparse)


def _held_terms(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(file_md5, page, terms): the terms that occur in the page's text; pages without any are left out.

    pages: file_md5, page, k; terms: file_md5, term. Texts are read where they lie, once for the terms of all files, so the
    array may hold terms of other files only. More terms than an automaton holds open the pages of their own file by their
    first two letters, ids only.
    """
    terms = terms.filter(F.length("term") > 0).distinct()
    try:
        import ahocorasick  # noqa: F401

        if is_small(terms.select("term").distinct(), MANY_TERMS):
            return contained_terms(pages, F.col("k"), terms, ["file_md5", "page"])
    except ImportError:
        pass
    # pairs of letters, and the last letter alone; one-letter terms are opened by any letter
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("k"), F.lit(1))), lambda i: F.substr("k", i, F.lit(2)))
    letters = F.array_distinct(F.concat(bigrams, F.split("k", "")))
    grams = pages.select("file_md5", "page", F.explode(letters).alias("g"))
    near = grams.join(terms.withColumn("g", F.left("term", F.lit(2))), ["file_md5", "g"])
    some = near.groupBy("file_md5", "page").agg(F.array_sort(F.collect_set("term")).alias("near"))
    held = pages.join(some, ["file_md5", "page"]).select(
        "file_md5", "page", F.filter("near", lambda x: F.contains(F.col("k"), x)).alias("terms"))
    return held.filter(F.size("terms") > 0)


def _term_sets(held: DataFrame) -> DataFrame:
    """(file_md5, set_page, terms): the different sets of terms of a file; the first page that has a set stands for it."""
    return stored(held.groupBy("file_md5", "terms").agg(F.min("page").alias("set_page")), "term-sets")


def _to_pages(found: DataFrame, sets: DataFrame, held: DataFrame) -> DataFrame:
    """What was found for the sets, for every page that has the set."""
    full = stored(found.join(sets, ["file_md5", "set_page"]).drop("set_page"), "found-sets")
    return lookup_join(held, full, ["file_md5", "terms"]).drop("terms")


def match_pages(pages: DataFrame, sheets: DataFrame, tokens: DataFrame) -> DataFrame:
    """The sheet whose name occurs in the page text; several go by how many tokens they share.

    pages: file_md5, page, text, a row per page; sheets: file_md5, sheet, sheet_no; tokens: file_md5, sheet, token. Each page text
    is read once for all names and tokens; only ids and terms leave it. Pages with the same terms are matched once.
    """
    s = sheets.select("file_md5", "sheet", "sheet_no", X.sheet_match_key(F.col("sheet")).alias("term")).filter("term <> ''").distinct()
    t = tokens.select("file_md5", "sheet", F.col("token").alias("term")).filter("term IS NOT NULL").distinct()
    p = pages.select("file_md5", "page", X.sheet_match_key(F.col("text")).alias("k"))
    held = stored(_held_terms(p, s.select("file_md5", "term").union(t.select("file_md5", "term"))), "page-terms")
    sets = _term_sets(held)
    each = sets.select("file_md5", "set_page", F.explode("terms").alias("term"))
    named = each.join(s, ["file_md5", "term"]).drop("term")
    shared = each.join(t, ["file_md5", "term"]).groupBy("file_md5", "set_page", "sheet").agg(F.count("*").alias("score"))
    # an empty token is in every text
    blank = t.filter("term = ''").select("file_md5", "sheet", F.lit(1).alias("blank"))
    hit = named.join(shared, ["file_md5", "set_page", "sheet"], "left").join(blank, ["file_md5", "sheet"], "left").fillna(0, ["score", "blank"])
    best = hit.groupBy("file_md5", "set_page").agg(
        F.max_by("sheet", F.struct(F.col("score") + F.col("blank"), -F.col("sheet_no"))).alias("sheet"), F.count("*").alias("n_named"))
    return _to_pages(best, sets, held)


def match_pages_weak(
    pages: DataFrame, sheets: DataFrame, tokens: DataFrame,
    min_score: int = C.SNAPSHOT["weak_min_score"], min_lead: int = C.SNAPSHOT["weak_min_lead"],
) -> DataFrame:
    """J14 without a literal name: the sheet that shares most tokens with the page, if it leads clearly.

    pages: file_md5, page, text; sheets: file_md5, sheet, sheet_no; tokens: file_md5, sheet, token. A page chooses the sheet with
    the most tokens that occur in its text, if these are ``min_score`` at least and ``min_lead`` more than the next sheet has.
    Each page text is read once; pages of a file with the same tokens are matched once, so only sets of tokens meet sheets.
    Tokens that all sheets of a file have add the same to each: they are counted per set, so sheets are never paired by them.
    """
    t = tokens.select("file_md5", "sheet", "token").filter(F.length("token") >= 2).distinct()
    n_sheets = sheets.groupBy("file_md5").agg(F.count("*").alias("n_sheets"), F.min_by("sheet", "sheet_no").alias("first_sheet"))
    known = t.groupBy("file_md5", "token").agg(F.count("*").alias("held_by")).join(n_sheets, "file_md5")
    p = pages.select("file_md5", "page", X.sheet_match_key(F.col("text")).alias("k"))
    held = stored(_held_terms(p, t.select("file_md5", F.col("token").alias("term"))), "page-terms")
    sets = _term_sets(held)
    key = ["file_md5", "set_page"]
    hit = sets.select(*key, F.explode("terms").alias("token")).join(known, ["file_md5", "token"])
    per_set = hit.groupBy(*key).agg(
        F.count_if(F.col("held_by") == F.col("n_sheets")).alias("shared"), F.max("n_sheets").alias("n_sheets"), F.max("first_sheet").alias("first_sheet"))
    own = hit.filter("held_by < n_sheets").select(*key, "token").join(t, ["file_md5", "token"])
    own = own.groupBy(*key, "sheet").agg(F.count("*").alias("own")).join(sheets.select("file_md5", "sheet", "sheet_no"), ["file_md5", "sheet"])
    best = top_rows(own, key, [F.col("own").desc(), F.col("sheet_no")], 2, "r").groupBy(*key).agg(
        F.max(F.when(F.col("r") == 1, F.col("sheet"))).alias("sheet"), F.max(F.when(F.col("r") == 1, F.col("own"))).alias("o1"),
        F.max(F.when(F.col("r") == 2, F.col("own"))).alias("o2"))
    out = per_set.join(best, key, "left")
    second = F.when(F.col("o2").isNotNull(), F.col("o2") + F.col("shared")).when((F.col("shared") > 0) & (F.col("n_sheets") > 1), F.col("shared")).otherwise(-1)
    out = out.withColumns({"score": F.coalesce("o1", F.lit(0)) + F.col("shared"), "second": second, "sheet": F.coalesce("sheet", "first_sheet")})
    out = out.filter((F.col("score") >= max(1, min_score)) & (F.col("score") >= F.col("second") + max(0, min_lead)))
    return _to_pages(out.select(*key, "sheet", "score", "second"), sets, held)


def backfill_pages(pages: DataFrame) -> DataFrame:
    """A page without sheet takes the sheet both of its neighbours agree on.

    A page is filled only if its next page has a sheet already, so filling never cascades.
    """
    w = W.partitionBy("file_md5", "seg").orderBy("page")
    near = with_halo(pages.withColumn("pos", F.col("page") - 1), "pos", 1, 1)
    prev, nxt = F.lag("sheet").over(w), F.lead("sheet").over(w)
    fill = F.col("sheet").isNull() & (prev == nxt)
    out = near.withColumn("_fill", F.coalesce(fill, F.lit(False))).withColumn("_prev", prev).filter("own")
    return out.select(
        "file_md5", "page", F.when(F.col("_fill"), F.col("_prev")).otherwise(F.col("sheet")).alias("sheet"),
        F.when(F.col("_fill"), "neighbor_window").when(F.col("sheet").isNull(), "unbound").otherwise(F.col("mode")).alias("mode"),
        F.when(F.col("_fill"), 0.45).when(F.col("sheet").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"),
    )


ACCEPTED_MODES = ["text_strict", "ocr_strict", "neighbor_window", "single_candidate"]


def pages_per_sheet(pages: DataFrame, n: int = C.SNAPSHOT["max_pages_per_sheet"]) -> DataFrame:
    """At most n accepted pages per sheet, in page order."""
    ok = pages.filter(F.col("sheet").isNotNull() & F.col("mode").isin(ACCEPTED_MODES))
    return top_rows(ok, ["file_md5", "sheet"], [F.col("page")], n, "nth")


def drawing_edges(nodes: DataFrame, connectors: DataFrame, reach: float = C.NODE_MATCH_DISTANCE) -> DataFrame:
    """Connectors to edges between the nodes nearest to their ends, if within reach.

    Ends and nodes meet through a grid of cells as wide as the reach (the cell and its eight
    neighbours), so only near candidates are compared. Ends at one spot have one nearest node, and of
    nodes at one spot only the first can be it: each spot is looked at once. nodes: node_no, name,
    x, y; connectors: conn_no, x1, y1, x2, y2.
    """
    key = X.node_key(F.col("name"))
    uniq = nodes.filter(key != "").groupBy(*SHEET, key.alias("_k")).agg(F.min_by(F.struct("node_no", "name", "x", "y"), "node_no").alias("n"))
    uniq = uniq.select(*SHEET, "n.*")
    enough = uniq.groupBy(*SHEET).agg(F.count("*").alias("c")).filter("c >= 2").select(*SHEET)

    def cell(c):
        return F.floor(c / reach).cast("long")

    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    placed = uniq.groupBy(*SHEET, "x", "y").agg(F.min(F.struct("node_no", "name")).alias("n")).select(*SHEET, "x", "y", "n.*")
    placed = placed.withColumn("gx", cell(F.col("x"))).withColumn("gy", cell(F.col("y")))
    ends = [F.struct(F.col(x).cast("double").alias("ex"), F.col(y).cast("double").alias("ey")) for x, y in (("x1", "y1"), ("x2", "y2"))]
    spots = connectors.select(*SHEET, F.explode(F.array(*ends)).alias("e")).select(*SHEET, "e.*").distinct().join(enough, SHEET, "left_semi")
    spots = spots.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    spots = spots.withColumn("gx", cell(F.col("ex")) + F.col("dx")).withColumn("gy", cell(F.col("ey")) + F.col("dy"))
    near = spots.join(placed, [*SHEET, "gx", "gy"])
    dist = F.sqrt((F.col("ex") - F.col("x")) * (F.col("ex") - F.col("x")) + (F.col("ey") - F.col("y")) * (F.col("ey") - F.col("y")))
    near = near.withColumn("dist", dist).filter(F.col("dist") <= reach)
    best = stored(near.groupBy(*SHEET, "ex", "ey").agg(F.min(F.struct("dist", "node_no", "name")).alias("b")), "nearest-nodes")
    both = connectors.select(*SHEET, "conn_no", *[e.alias(n) for e, n in zip(ends, ("_1", "_2"))])
    for end, side in (("_1", "s"), ("_2", "d")):
        found = best.select(*SHEET, F.struct("ex", "ey").alias(end), F.struct("b.dist", "b.name").alias(side))
        both = both.join(found, [*SHEET, end]).drop(end)
    both = both.filter("s.name <> d.name")
    conf = F.greatest(F.lit(0.4), F.least(F.lit(0.95), 1.0 - (F.col("s.dist") + F.col("d.dist")) / 80.0))
    return both.groupBy(*SHEET, F.col("s.name").alias("src"), F.col("d.name").alias("dst")).agg(
        F.min_by(F.bround(conf * 100) / 100, "conn_no").alias("confidence"), F.lit(C.CONNECT).alias("relation_type")
    )


def media_candidates(images: DataFrame, n: int) -> DataFrame:
    """The first n images by name, then only those large enough."""
    named = images.filter(F.lower("name").rlike(r"\.(png|jpe?g|bmp|webp)$"))
    first = top_rows(named, ["file_md5"], [F.col("name")], n, "nth")
    side = F.least("width", "height")
    return first.filter((F.col("width") * F.col("height") >= 120000) & (side >= 220) & F.upper("format").isin("PNG", "JPEG", "JPG", "WEBP", "BMP"))


def diagram_graphs(blocks: DataFrame) -> DataFrame:
    """Nodes (first of each key) and edges per sheet from diagram blocks, as rows."""
    b = blocks.filter(F.col("source_parser") == "xlsx_diagram").withColumn("sheet", F.coalesce("sheet", F.lit("sheet")))

    def field(n):
        return X.blank_to_null(X.clean_text(F.col("row_json")[n]))

    name = F.coalesce(field("name"), X.blank_to_null(X.clean_text(F.regexp_replace("text", r"\A(.*?)\[diagram_node\]", "$1"))))
    nodes = b.filter("type = 'diagram_node'").select(*SHEET, "block_index", name.alias("name")).filter("name is not null")
    nodes = nodes.groupBy(*SHEET, X.node_key(F.col("name")).alias("key")).agg(F.min_by("name", "block_index").alias("name"))
    pat = r"(.+?)\s*->\s*(.+?)(?:\s*;|$)"
    both = field("src").isNotNull() & field("dst").isNotNull()
    src = F.when(both, field("src")).otherwise(X.blank_to_null(X.clean_text(F.regexp_extract("text", pat, 1))))
    dst = F.when(both, field("dst")).otherwise(X.blank_to_null(X.clean_text(F.regexp_extract("text", pat, 2))))
    edges = b.filter("type = 'diagram_edge'").select(
        *SHEET, src.alias("src"), dst.alias("dst"), F.coalesce(field("relation_type"), F.lit(C.CONNECT)).alias("relation_type")
    ).filter("src is not null and dst is not null")
    return nodes.select(*SHEET, F.lit("node").alias("kind"), "name", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("relation_type")).unionByName(
        edges.select(*SHEET, F.lit("edge").alias("kind"), F.col("src").alias("name"), "dst", "relation_type")
    )


def visual_page_rows(records: DataFrame, units: DataFrame) -> DataFrame:
    """Page images of page-level sources, first per image path, linked to their unit."""
    from marginalia.operators.blocks import document_unit

    path = X.clean_text(F.col("storage_path"))
    ok = records.filter(
        F.lower(X.strip(F.col("source_parser"))).isin(
            "xlsx_page_render", "xlsx_sheet_snapshot", "pdf_page_render", "docx_page_render", "ppt_slide_render"
        ) & (path != "")
    )
    keep = [c for c in records.columns if c not in ("file_md5", "storage_path")]
    one = ok.groupBy("file_md5", path.alias("image_path")).agg(F.min_by(F.struct(*keep), "record_no").alias("r")).select("file_md5", "image_path", "r.*")
    sheet, section = (X.blank_to_null(X.clean_text(F.col(c))) for c in ("sheet", "section"))
    unit = document_unit(F.col("file_type"), F.lit("visual_page"), F.col("page"), sheet, section, F.lit(0))
    one = one.withColumn("u", unit).withColumn("sheet", sheet).withColumn("section", section)
    label = F.coalesce(
        F.concat(F.lit("sheet:"), "sheet"), F.concat(F.lit("page:"), F.col("page").cast("string")),
        F.concat(F.lit("section:"), "section"), F.col("u.unit_key"),
    )
    u = units.select("file_md5", F.col("unit_key"), F.col("unit_id").alias("document_unit_id"))
    return one.withColumn("unit_key", F.col("u.unit_key")).join(u, ["file_md5", "unit_key"], "left").select(
        "file_md5", "image_path", "unit_key", F.col("u.unit_type").alias("unit_type"), "document_unit_id", "page", "sheet",
        "section", label.alias("page_label"), F.lit("accepted").alias("quality_status"),
    )


def link_analyses(analyses: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses with their page by image path, and the ones without a page."""
    p = pages.select("file_md5", "image_path", "visual_page_id").filter(F.col("image_path") != "")
    return analyses.join(p, ["file_md5", "image_path"]), analyses.join(p, ["file_md5", "image_path"], "left_anti")
