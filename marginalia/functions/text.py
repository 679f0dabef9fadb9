"""Text normalisation, truncation and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import constants as C

ANY_WORD = f"[{C.CJK}A-Za-z0-9]"


def strip(col: Column) -> Column:
    """Trim Unicode white space at both ends (SQL trim only knows the space)."""
    return F.btrim(col, F.lit(C.WS_CHARS))


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(col) > 0, col)


def clean_text(col: Column) -> Column:
    """line ends, blanks, spaces inside CJK runs, blank lines, trim; null becomes ''.

    Most texts hold nothing to rewrite; one search tells, and only the others run the rules. The text is worked out once,
    whatever expression gives it.
    """
    return bind(F.coalesce(col.cast("string"), F.lit("")), _clean)


def _clean(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, rf"(?<=[{C.CJK}]){C.WS}+(?=[{C.CJK}])", "")
    t = F.regexp_replace(t, rf"(?<=[{C.CJK}]){C.WS}*\|{C.WS}*(?=[{C.CJK}])", "")
    t = F.regexp_replace(t, rf"\n{C.WS}*\n{C.WS}*\n+", "\n\n")
    untidy = raw.rlike(rf"[\r\t{C.CJK}]|  |\n{C.WS}*\n")
    return strip(F.when(untidy, t).otherwise(raw))


def collapse_ws(col: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(col, F.lit("")), f"{C.WS}+", " "))


def _drop_placeholders(t: Column) -> Column:
    w = C.WS
    for pattern, by in (
        (rf"(?:(?:^|\||;){w}*col_\d+{w}*:?{w}*)", " | "),
        (rf"\|{w}*\|+", "|"),
        (rf";{w}*;+", ";"),
        (rf"(?:{w}*\|{w}*){{2,}}", " | "),
        (rf"(?:{w}*;{w}*){{2,}}", " ; "),
        (rf"\A{w}*[\|;:\-]+{w}*|{w}*[\|;:\-]+{w}*\z", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    return t


def is_table_like(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return k.contains("table") | k.contains("row") | k.contains("header")


def clean_preview(text: Column, kind: Column) -> Column:
    """remove empty-column placeholders and doubled separators from table previews."""
    def of_table(base):
        return bind(clean_text(_drop_placeholders(base)), lambda t: F.when(t.rlike(ANY_WORD), t).otherwise(""))

    return bind(clean_text(text), lambda base: F.when(~is_table_like(kind), base).otherwise(of_table(base)))


def short_text(col: Column, limit: int = 160) -> Column:
    """cut with the full length noted."""
    t = clean_text(col)
    n = F.length(t)
    return F.when(n <= limit, t).otherwise(
        F.concat(F.left(t, F.lit(limit)), F.lit("...(len="), n.cast("string"), F.lit(")"))
    )


def trim_preview(col: Column, limit: int = 240) -> Column:
    t = collapse_ws(col)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("...")))


def safe_text(col: Column, limit: int = 4000) -> Column:
    return F.left(strip(F.coalesce(col, F.lit(""))), F.lit(limit))


def clean_markdown(col: Column) -> Column:
    """drop heading marks, bullets, fences, inline code, links, bold and italics."""
    t = F.coalesce(col, F.lit(""))
    for pattern, by in (
        (rf"(?m)^#+{C.WS}+", ""),
        (rf"(?m)^[-*+]{C.WS}+", ""),
        (r"(?s)```[^`]*```", ""),
        (r"`[^`]+`", ""),
        (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
        (r"\*\*([^\*]+)\*\*", "$1"),
        (r"\*([^\*]+)\*", "$1"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return clean_text(t)


def node_key(col: Column) -> Column:
    """F05."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), f"{C.WS}+", "")


def match_key(col: Column) -> Column:
    """the form used to look anchors up in evidence."""
    return F.regexp_replace(
        F.lower(F.coalesce(col, F.lit(""))), rf"({C.WS}|[-_|])+", ""
    )


def sheet_match_key(col: Column) -> Column:
    """F06, sheet variant: also drops the katakana middle dot, keeps '|'."""
    return F.translate(F.lower(clean_text(col)), "　・ -_", "")


def fallback_page_id(name: Column, hint: Column) -> Column:
    """F07."""
    n = clean_text(name)
    slug = F.regexp_replace(F.regexp_replace(F.lower(n), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.coalesce(
        blank_to_null(clean_text(hint)),
        F.when(n == "", "unknown_page"),
        blank_to_null(F.left(slug, F.lit(80))),
        F.concat(F.lit("page_"), F.left(F.md5(n), F.lit(8))),
    )


def confidence(col: Column, default: float | Column = 0.55) -> Column:
    """clamped to [0, 1]; the default where it is no number (least/greatest would skip a null)."""
    v = col.try_cast("double")
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(d)


def quality_tier(score: Column) -> Column:
    """F09."""
    return (
        F.when(score >= C.ACCEPTED_MIN_SCORE, "accepted")
        .when(score >= C.WEAK_MIN_SCORE, "weak")
        .otherwise("rejected")
    )


def page_text_quality(text: Column) -> Column:
    """struct(chars, words, valid_ratio) of already cleaned text."""
    words = F.regexp_extract_all(text, F.lit(f"({ANY_WORD}{{2,}})"), F.lit(1))
    valid = F.filter(words, lambda w: w.rlike(f"[{C.CJK}A-Za-z]"))
    n = F.size(words)
    return F.struct(
        F.length(text).alias("chars"),
        n.alias("words"),
        F.when(n > 0, F.size(valid) / n).otherwise(0.0).alias("valid_ratio"),
    )


def mask(col: Column, visible: int = 4) -> Column:
    """F30."""
    n = F.length(col)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "****")
        .when(n <= visible, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.left(col, F.lit(visible)), F.repeat(F.lit("*"), n - visible)))
    )


def tokens(col: Column) -> Column:
    """Lower-case word tokens; Han and Hiragana one by one, Katakana by run."""
    word = (
        r"([\p{IsHan}\p{IsHiragana}]|[\p{IsKatakana}ー]+"
        r"|[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]]+)"
    )
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(word), F.lit(1))


def any_contained(text: Column, words: list[str]) -> Column:
    """True when one of a fixed list of words occurs in the text."""
    return text.rlike("|".join(rf"\Q{w}\E" for w in words))


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of a fixed list of words occur in the text."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))


def bind(value: Column, body) -> Column:
    """Evaluate an expression once per row and use it several times in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_first(arr: Column, key) -> Column:
    """Order-preserving dedupe of a (small) array on key(element)."""
    return bind(
        arr,
        lambda xs: bind(
            F.transform(xs, key),
            lambda keys: F.filter(xs, lambda _, i: F.array_position(keys, keys[i]) == i + 1),
        ),
    )


def clean_list(arr: Column, limit: int = 40) -> Column:
    """clean, drop blanks, keep the first of each key; the limit is applied before."""
    cleaned = F.filter(F.transform(F.slice(arr, 1, limit), clean_text), lambda x: node_key(x) != "")
    return F.coalesce(keep_first(cleaned, node_key), F.array().cast("array<string>"))


def comma_list(col: Column) -> Column:
    """F26."""
    return F.filter(
        F.transform(F.split(F.coalesce(col, F.lit("")), ","), strip), lambda x: x != ""
    )


def pairs_to_map(col: Column) -> Column:
    """'k: v ; k: v' to a map, last value of a key wins."""
    segs = F.filter(F.split(clean_text(col), ";"), lambda s: s.contains(":"))
    pairs = F.transform(
        segs,
        lambda s: F.struct(
            clean_text(F.substring_index(s, ":", 1)).alias("k"),
            clean_text(F.substr(s, F.instr(s, F.lit(":")) + 1)).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.map_from_entries(F.reverse(keep_first(F.reverse(pairs), lambda p: p["k"])))


def ym(year: Column, month: Column) -> Column:
    """YYYYMM with the month clamped."""
    m = F.least(F.greatest(month.cast("int"), F.lit(1)), F.lit(12))
    return year.cast("int") * 100 + m


def months_since(end_ym: Column, as_of) -> Column:
    """whole months from end_ym to as_of, never negative."""
    now = F.year(as_of) * 12 + F.month(as_of)
    end = F.floor(end_ym / 100).cast("int") * 12 + F.pmod(end_ym, F.lit(100))
    return F.greatest(now - end, F.lit(0)).cast("int")


def period_labels(col: Column) -> Column:
    """struct(start, end) around the first separator kind present."""
    t = strip(F.coalesce(col, F.lit("")))
    sep = F.coalesce(*[F.when(t.contains(s), s) for s in C.PERIOD_SEPARATORS])
    parts = F.filter(
        F.transform(F.split(t, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))), strip), lambda p: p != ""
    )
    two = F.size(parts) >= 2
    return F.struct(
        F.when(two, F.element_at(parts, 1)).otherwise(t).alias("start"),
        F.when(two, F.element_at(parts, -1)).otherwise(t).alias("end"),
    )


def period_duration(start: Column, end: Column) -> Column:
    """inclusive months as text, the two labels, or unknown."""
    pat = r"(\d{4})\D+(\d{1,2})"

    def months(c):
        return F.regexp_extract(c, pat, 1).try_cast("int") * 12 + F.regexp_extract(c, pat, 2).try_cast("int")

    n = months(end) - months(start) + 1
    return (
        F.when(n >= 1, F.concat(n.cast("string"), F.lit("か月")))
        .when((start != "") & (end != "") & (start != end), F.concat(start, F.lit(" ～ "), end))
        .otherwise("不明")
    )


def graph_label(kind: Column, table: dict[str, str], default: str, lower: bool) -> Column:
    """map a node or relation type to a graph label."""
    key = strip(F.coalesce(kind, F.lit("")))
    key = F.lower(key) if lower else key
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    label = F.regexp_replace(F.coalesce(lookup[key], F.lit(default)), "[^A-Za-z0-9_]", "_")
    return F.regexp_replace(label, r"\A(?=\d)", "_")


def edge_key(src: Column, kind: Column, dst: Column) -> Column:
    """F28."""
    return F.concat(src, F.lit("->"), kind, F.lit("->"), dst)


def doc_key(file_md5: Column, chunk_id: Column) -> Column:
    """F28."""
    return F.concat_ws("_", file_md5, chunk_id.cast("string"))


def source_snapshot(sources: Column) -> Column:
    """the first ten sources as JSON of six fields."""
    fields = ["file_name", "file_md5", "chunk_id", "page", "sheet", "score"]
    return F.to_json(
        F.transform(F.slice(sources, 1, 10), lambda s: F.struct(*[s[f].alias(f) for f in fields])),
        {"ignoreNullFields": "false"},
    )


def citations(answer: Column) -> Column:
    """the [[SRC|...]] marks of an answer as an array of structs, first of each key kept."""
    mark = r"(\[\[SRC\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|[^|]*\|[^\]]*\]\])"
    marks = F.regexp_extract_all(answer, F.lit(mark), F.lit(1))

    def parse(m):
        names = ["index", "file_name", "file_md5", "chunk_id", "page", "sheet"]
        inner = F.substr(m, F.lit(7), F.length(m) - 8)
        return bind(
            F.transform(F.split(inner, r"\|"), strip),
            lambda f: F.struct(*[f[i].alias(n) for i, n in enumerate(names)]),
        )

    parsed = F.filter(F.transform(marks, parse), lambda r: r["file_md5"] != "")
    return keep_first(
        parsed, lambda r: F.struct(r["file_md5"], r["chunk_id"], r["page"], r["sheet"])
    )
