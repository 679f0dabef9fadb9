"""Text and question rules on small rows, CJK included."""

from pyspark.sql import functions as F

from marginalia.functions import questions as Q
from marginalia.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_text_rules(spark):
    assert one(spark, None, X.clean_text) == ""
    assert one(spark, "a\r\nb\rc", X.clean_text) == "a\nb\nc"
    assert one(spark, "a \t  b", X.clean_text) == "a b"
    assert one(spark, "画 面\u3000定 | 義", X.clean_text) == "画面定義"
    assert one(spark, "a\n \n\n\nb", X.clean_text) == "a\n\nb"
    assert one(spark, "\u3000x\u00a0", X.clean_text) == "x"
    assert one(spark, "ab 画 cd", X.clean_text) == "ab 画 cd"


def test_preview_and_truncation(spark):
    table = lambda c: X.clean_preview(c, F.lit("table_row"))
    assert one(spark, "col_1: | col_2: | x", table) == "x"
    assert one(spark, "| ; -", table) == ""
    assert one(spark, "x" * 200, X.short_text) == "x" * 160 + "...(len=200)"


def test_keys_and_ids(spark):
    assert one(spark, " Node A\u3000b ", X.node_key) == "nodeab"
    assert one(spark, "A-b_c|d\u3000e", X.match_key) == "abcde"
    page = lambda c: X.fallback_page_id(c, F.lit(None).cast("string"))
    assert one(spark, "Screen #1!", page) == "screen_1"
    assert one(spark, "", page) == "unknown_page"
    assert one(spark, "画面", page).startswith("page_")


def test_confidence_keeps_default_for_non_numbers(spark):
    got = [one(spark, v, X.confidence) for v in ("-1", "0.4", "7", "x", None)]
    assert got == [0.0, 0.4, 1.0, 0.55, 0.55]


def test_periods(spark):
    p = one(spark, "2024年1月 -> 2024年3月", X.period_labels)
    assert (p["start"], p["end"]) == ("2024年1月", "2024年3月")
    assert one(spark, p["start"], lambda c: X.period_duration(c, F.lit(p["end"]))) == "3か月"
    assert one(spark, "2024~", X.period_labels)["start"] == "2024~"


def test_pairs_and_citations(spark):
    assert one(spark, "a: 1 ; b: x:y ; : z ; a: 2", X.pairs_to_map) == {"a": "2", "b": "x:y"}
    text = "t [[SRC|1|f|md|3||s]] u [[SRC|2|f|md|3||s]] [[SRC|3|g||1||]]"
    got = one(spark, text, X.citations)
    assert [(r["index"], r["file_md5"], r["sheet"]) for r in got] == [("1", "md", "s")]


def test_question_terms_in_japanese(spark):
    q = "田中さんの経歴を教えて System_A"
    assert one(spark, q, Q.query_keywords) == ["田中さんの経歴を教えて", "System_A"]
    signals = one(spark, q, Q.entity_signals)
    assert [(s["term"], s["entity_type"], s["confidence"]) for s in signals] == [("田中", "named", 0.74), ("経歴", "named", 0.74), ("SystemA", "named", 0.68)]
    strong = one(spark, "田中さんの経歴は", lambda c: Q.strong_anchors(c, F.lit("general")))
    assert "田中" in strong and "経歴" not in strong


def test_intent_priority(spark):
    cases = {
        "AとBを比較して流程を見せて": "compare_query", "件数を集計": "statistics_query", "工程の期間": "schedule_query",
        "画面レイアウト": "layout_query", "画面遷移図": "flow_query", "最近の案件": "timeline_query", "なぜ空は青い": "fact_lookup",
    }
    for q, want in cases.items():
        assert one(spark, q, Q.intent) == want, q


def test_top_n(spark):
    assert [one(spark, q, Q.top_n) for q in ("top 5 件", "最近99个", "三个", "なし")] == [5, 20, 3, 3]


def test_anchor_variants(spark):
    assert set(one(spark, "刘伟 画面", Q.anchor_variants)) >= {"刘伟 画面", "刘伟画面", "劉偉 画面"}
    assert "ログイン" in one(spark, "ログイン画面", Q.anchor_variants)


def test_relation_lines(spark):
    assert one(spark, "A から入力する", Q.relation_type) == "输入"
    assert one(spark, "A -> B", Q.relation_type) == "连接"
    assert one(spark, "受注 DB", Q.relation_type) is None
    assert one(spark, "受注 DB", Q.likely_node) is True
    assert one(spark, "123", Q.likely_node) is False


def test_memory_slots(spark):
    assert one(spark, "基幹システムの期間は?", Q.memory_subject) == "基幹システム"
    assert one(spark, "いつから始まる", Q.memory_constraint) == "期間"
    assert one(spark, "シート「計画表」を見て", Q.memory_scope) == "シート:計画表"


def test_tokens(spark):
    assert one(spark, "Hello, 世界 カタカナ wörld_1", X.tokens) == ["hello", "世", "界", "カタカナ", "wörld_1"]
