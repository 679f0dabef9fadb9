"""Word lists, limits, patterns and tables that results depend on.

Everything here is data that has to be equal for results to be equal; no logic.
"""

from __future__ import annotations

# --- fixed values: character classes -------------------------------------------------
# Unicode white space as Python's str.isspace sees it; Java's \s is ASCII only.
WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    + "".join(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
HAN = r"\x{3400}-\x{9fff}"
HIRAGANA = r"\x{3040}-\x{309f}"

# --- fixed values: limits ------------------------------------------------------------
CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
PREVIEW_CHARS = 500
ACCEPTED_MIN_SCORE = 80
WEAK_MIN_SCORE = 60
MISSING_IMAGE_CAP = 55
INVALID_CAP = 45
RRF_K = 60.0
BM25_K1 = 1.2
BM25_B = 0.75
EVIDENCE_MIN_SCORE = 0.18
HISTORY_KEEP = 20
MEMORY_TURNS = 4
DONE_TTL_DAYS = 7
IDLE_SECONDS = 3600
EMBED_BATCH = 100
NODE_WINDOW_LINES = 6
MAX_PATH_HOPS = 6
NODE_MATCH_DISTANCE = 25.0
DEFAULT_TAG = "DEFAULT"
ADMIN_ROLE = "ADMIN"

# --- fixed values: sheet snapshot thresholds (defaults, all overridable) ---------------
SNAPSHOT = dict(
    node_threshold=6, low_chars_max=320, low_token_max=120, low_char_per_cell=8.0,
    low_distinct_max=120, low_cells_min=8, weak_min_score=3, weak_min_lead=1, max_pages_per_sheet=3,
)

# --- fixed values: file states --------------------------------------------------------
STATUS_UPLOADING, STATUS_MERGED, STATUS_PROCESSING, STATUS_DONE, STATUS_FAILED = 0, 1, 2, 3, 4

# --- fixed values: parsers and extensions ----------------------------------------------
VISION_PARSERS = ["vlm_sheet_snapshot", "vlm_diagram"]
XLSX_TYPES = ["xlsx", "xlsm", "xltx", "xltm"]
DIAGRAM_LINE_TYPES = ["diagram_node", "diagram_edge", "diagram_summary"]
DIAGRAM_LINE_PARSERS = ["xlsx_diagram", "vlm_diagram"]
HEADER_HINTS = [
    "id", "no", "name", "title", "type", "status", "date", "sheet", "page",
    "項目", "項番", "番号", "名称", "名前", "摘要", "概要", "種別", "担当", "更新日", "作成日",
]

# --- fixed values: knowledge-base profiles ----------------------------------------------
PROFILE_FIELDS = (
    "profile_id string, chunk_size int, chunk_overlap int, enable_relation_index boolean, "
    "query_expand_terms string, ocr_min_chars int, ocr_min_words int, ocr_min_valid_ratio double, "
    "ocr_doc_trigger_ratio double, ocr_no_text_streak int, ocr_max_pages int, "
    "w_vector double, w_bm25 double, w_relation double"
)
PROFILES = [
    ("general", 900, 120, True, "", 70, 15, 0.30, 0.50, 2, 12, 0.40, 0.40, 0.20),
    ("design", 1100, 150, True,
     "設計書 基本設計 詳細設計 IF インターフェース テーブル バッチ 依存 関係 フロー",
     100, 20, 0.35, 0.40, 2, 25, 0.30, 0.25, 0.45),
    ("policy", 950, 140, False, "規程 規定 手順 承認 稟議 申請 施行 適用 範囲 例外",
     80, 18, 0.33, 0.45, 2, 15, 0.25, 0.55, 0.20),
    ("ops", 900, 120, True, "障害 アラート 監視 インシデント 復旧 原因 対応 手順 変更",
     70, 15, 0.30, 0.50, 2, 12, 0.30, 0.35, 0.35),
]
LEGACY_PROFILES = {"resume": "general", "legal": "policy"}
DEFAULT_PROFILE = "general"

# --- fixed values: intent keywords -------------------------------------------------------
INTENT_KEYWORDS = {
    "COMPARE_QUERY_KEYS": [
        "比较", "對比", "对比", "差异", "区别", "比", "vs", "versus",
        "比較", "差分", "違い", "どちら", "compare", "difference",
    ],
    "STATISTICS_QUERY_KEYS": [
        "统计", "总数", "数量", "占比", "平均", "合计", "汇总",
        "何件", "件数", "割合", "合計", "集計",
        "count", "total", "average", "ratio", "summary",
    ],
    "TIMELINE_QUERY_KEYS": [
        "最近", "最新", "直近", "recent", "latest",
        "项目", "プロジェクト", "案件", "经历", "経歴", "职历", "職歴",
        "职位", "職位", "担当", "役割", "ポジション",
    ],
    "SCHEDULE_QUERY_KEYS": [
        "スケジュール", "工程", "進捗", "ガント", "gantt", "schedule",
        "期間", "開始", "終了", "工期", "いつから", "いつまで", "いつ",
        "日程", "締切", "納期", "deadline", "start", "end", "duration",
    ],
    "FLOW_QUERY_KEYS": [
        "流程", "路径", "链路", "上游", "下游", "依赖",
        "flow", "path", "route", "経路", "連携", "呼び出し", "入力", "出力",
        "関係", "接続",
        "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ",
        "画面遷移図", "遷移図", "画面遷移", "遷移元", "遷移先", "シーケンス図", "diagram",
    ],
    "LAYOUT_QUERY_KEYS": [
        "レイアウト", "layout", "画面レイアウト", "ui", "ユーザーインターフェース",
        "画面項目", "項目配置", "入力欄", "ボタン配置", "表示項目", "画面定義",
    ],
    "STRICT_RELATION_KEYS": [
        "影響", "依存", "連携", "上流", "下流", "呼び出し", "入力", "出力", "接続", "関連",
        "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ",
        "遷移元", "遷移先", "遷移図", "画面遷移図", "画面遷移",
        "flow", "impact", "dependency", "upstream", "downstream",
    ],
    "RELATION_PRESENTATION_KEYS": [
        "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ",
        "フロー", "流れ", "関係", "連携",
        "画面遷移図", "遷移図", "画面遷移", "シーケンス図",
        "図", "イメージ", "diagram", "dependency", "flow", "architecture",
    ],
    "VISUAL_DIAGRAM_REQUEST_KEYS": [
        "画面遷移図", "遷移図", "画面遷移", "構成図", "システム図", "システム構成図",
        "図", "イメージ", "diagram", "flow chart", "architecture diagram",
    ],
    "TEXT_EXPLANATION_KEYS": [
        "とは", "説明", "概要", "目的", "定義", "教えて", "是什么", "说明", "解説",
        "what", "summary", "overview", "define",
    ],
    "GENERIC_TOPIC_TERMS": [
        "定義", "確認", "説明", "概要", "詳細", "画面", "レイアウト", "画面レイアウト", "layout",
        "仕様", "要件", "設計", "基本設計", "詳細設計", "機能", "流程", "フロー", "構成", "構成図",
        "システム", "画面遷移", "ui", "項目", "表示", "入力", "出力",
    ],
}
ASK_DISTANCE_KEYS = ["距离今天", "距今", "多久", "多少月", "how long"]
SCHEDULE_EXPANSION = "スケジュール 工程 期間 開始 終了 工期 日程 進捗"
FLOW_REWRITE = "画面遷移図にある各画面の遷移関係を一覧で教えてください"
LAYOUT_REWRITE = "画面レイアウトにある主要な構成要素と表示項目を教えてください"
FLOW_PRESENTATION = (
    "画面遷移図|遷移図|画面遷移|各画面間の関係|画面間の関係|接続関係|関係を教えて|図を教えて|図お願い|見せて"
)
LAYOUT_PRESENTATION = "画面レイアウト|レイアウト|画面構成|画面を見せて|画面を教えて"
TOP_N_PATTERN = r"(?:top|近|最近|latest|recent)?\s*([1-9]\d?)\s*(?:个|條|条|件|項|项|つ)?"
VISUAL_WISH_KEYS = ["見せて", "画像", "図", "レイアウト", "画面", "スクリーンショット"]
LIST_STYLE_KEYS = ["一覧", "列出", "list", "show all", "全部"]

# --- fixed values: relation extraction ------------------------------------------------------
RELATION_DOC_HINTS = [
    "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ", "architecture", "flow", "フロー",
    "流程", "流程图", "架构图", "系统构成",
]
RELATION_KEYWORDS = {
    "输入": ["输入", "入力", "ingest", "input"],
    "输出": ["输出", "出力", "output"],
    "调用": ["调用", "呼び出", "call", "invoke", "mcp経由"],
    "依赖": ["依赖", "依存", "depends", "連携"],
    "获取": ["取得", "获取", "fetch", "read"],
    "反映": ["反映", "同期"],
    "连接": ["接続", "连接", "connect"],
}
CONNECT = "连接"
ARROWS = ["->", "→", "⇒", "⇢"]
RELATION_QUERY_HINTS = [
    "流程", "路径", "链路", "上游", "下游", "依赖", "经过",
    "flow", "route", "path", "from", "to", "→", "->",
    "順序", "経路", "入力", "出力", "連携", "呼び出し",
    "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ",
]
RELATION_STOP_TERMS = [
    "请", "帮我", "说明", "解释", "是什么", "怎么", "如何", "一下",
    "流程", "路径", "链路", "上游", "下游", "依赖", "关系",
    "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ",
    "教えて", "ください", "ですか", "について",
    "from", "to", "flow", "path", "route", "and", "or", "the", "a", "an",
]
RELATION_TERM_SPLIT = r"[\s\u3000,，。！？\(\)（）\[\]【】\-_/\\:：;；]+"
ARROW_SIDE = r"[A-Za-z0-9_\-\(\)（）/\x{3040}-\x{30ff}\x{3400}-\x{9fff}・\s]{2,80}"
ARROW_PATTERN = f"({ARROW_SIDE})" + r"\s*(?:->|→|⇒|⇢|＞)\s*" + f"({ARROW_SIDE})"
NUMBER_LINE = r"^[0-9０-９一二三四五六七八九十]+$"
PATH_MARK = "[流程路径]"
RELATION_MARK = "[关系]"
TIMELINE_MARK = "[时间线]"
RELATION_TEXT_MARKS = ["入力>", "出力>", "输出>"]
UNKNOWN_FILE = "未知文件"
UNKNOWN_ROLE = "未明确角色"
UNNAMED_PROJECT = "未命名项目"

# --- fixed values: graph labels -----------------------------------------------------------------
NODE_LABELS = {
    "page": "Page", "component": "Component", "flow_node": "FlowNode", "task": "Task", "entity": "Entity",
}
EDGE_LABELS = {
    "连接": "FLOWS_TO", "输入": "TRIGGERS", "输出": "BELONGS_TO", "调用": "TRIGGERS",
    "依赖": "DEPENDS_ON", "获取": "DEPENDS_ON", "反映": "FLOWS_TO", "接続": "NAVIGATES_TO",
}

# --- fixed values: anchors ------------------------------------------------------------------------
ANCHOR_STOP_WORDS = [
    "なに", "何", "どれ", "どの", "どう", "について", "教えて", "ください",
    "最近", "最新", "直近", "ですか", "ますか",
    "什么", "哪些", "怎么", "如何", "这个", "那个", "一下",
    "what", "which", "how", "latest", "recent",
    "project", "projects", "role", "roles",
]
DESIGN_STOP_WORDS = [
    "db", "database", "データベース", "テーブル", "カラム", "項目",
    "主キー", "外部キー", "インデックス", "制約",
    "参照", "結合", "join", "正規化", "er図",
    "追加", "変更", "削除", "影響範囲", "api", "if",
    "設計書", "基本設計", "詳細設計", "内部設計", "外部設計",
    "要件", "仕様", "画面", "帳票",
]
STRONG_STOP_WORDS = [
    "履歴書", "経歴書", "職歴", "経歴", "プロジェクト", "案件", "役割", "担当", "ポジション",
    "最近", "最新", "直近", "強み", "スキル", "能力", "経験", "紹介", "説明",
    "構成図", "システム図", "システム構成図", "構成", "アーキテクチャ", "フロー", "関係図", "連携図", "システム",
    "定義", "確認", "画面", "レイアウト", "画面レイアウト",
    "画面遷移図", "遷移図", "画面遷移", "遷移元", "遷移先",
    "お願い", "お願いします", "みせて", "見せて",
    "なに", "何", "どれ", "どう",
    "简历", "项目", "职位", "擅长", "技能", "能力", "经验", "什么", "哪些", "怎么", "如何",
    "please", "what", "which", "how",
    "いつから", "いつまで", "いつからいつまで", "いつ", "何月", "何日",
]
QUESTION_FRAGMENTS = [
    "ですか", "ますか", "でしょう", "吗", "嗎", "呢", "？", "?", "一下",
    "比较", "對比", "比一下", "何件", "いくつ", "どれ", "なに", "何",
    "いつ", "いつから", "いつまで", "什么时候",
]
QUESTION_HEAD = "^(何|哪|どの|どれ|なに|いつ)"
HONORIFIC_TAIL = "(さん|様|氏|ちゃん|くん)$"
PARTICLE_TAIL = "(の|は|が|を|に|で|と|って).*$"
STRONG_PARTICLE_TAIL = "(の|は|が|を|に|で|と).*$"
STRONG_SUFFIXES = [
    "(ですか|ますか|でしょうか|について|とは|って)$",
    "(何ですか|なに|何|どれ|どのくらい|どんな|教えて)$",
    "(お願い|お願いします|みせて|見せて)$",
    "(擅长什么|擅長什麼|是什么|是什麼|有哪些|有哪一些|怎么|如何|多少|最近|最新)$",
    "(ね|よ|かな|か|呢|吗|嗎|嘛|呀|啊)$",
]
ENTITY_BEFORE_PARTICLE = r"([\x{3400}-\x{9fff}]{2,16})(?:さん|様|氏|ちゃん|くん)?(?:の|は|が|を|に|で|と|って)"
NAME_BEFORE_PARTICLE = (
    r"([\x{3400}-\x{9fff}]{2,12})(?:さん|氏|様|ちゃん|くん)?(?:の|は|が|を|に|で|と|について|に関して)"
)
IDENTIFIER_PATTERNS = [
    r"[A-Za-z][A-Za-z0-9_]{2,63}",
    r"[A-Za-z][A-Za-z0-9_]{1,63}(?:\.[A-Za-z][A-Za-z0-9_]{1,63}){1,2}",
    r"[A-Z]{2,}[0-9]{2,}",
    r"(?:IF|API)[-_][A-Za-z0-9_]{2,}",
    r"[A-Za-z][A-Za-z0-9_]{2,}_(?:id|cd|code|no|num|key)",
    r"(?:tbl|t)_[A-Za-z0-9_]{2,}",
]
DOTTED_TOKEN = r"[A-Za-z][A-Za-z0-9_]{1,63}(?:\.[A-Za-z][A-Za-z0-9_]{1,63}){1,2}"
TRIMMED_SUFFIXES = ["画面", "ページ", "screen", "page"]
SIMPLIFIED = "婵莲华伟杰丽国东龙叶陈刘张杨黄"
TRADITIONAL = "嬋蓮華偉傑麗國東龍葉陳劉張楊黃"

# --- fixed values: schedule and timeline ----------------------------------------------------------
SCHEDULE_STOP_WORDS = [
    "スケジュール", "期間", "開始", "終了", "工期", "進捗", "工程",
    "いつ", "いつから", "いつまで", "教えて", "ください", "ですか",
]
PERIOD_SEPARATORS = ["->", "～", "~", "至"]
SCHEDULE_TEXT = (
    r"sheet=(.*?)\s*;\s*task=(.*?)\s*;\s*period=(.*?)(?:\s*;\s*detail=(.*?))?(?:\s*;\s*confidence=([0-9.]+))?$"
)
TIMELINE_TEXT = r"项目:\s*(.*?)\s*;\s*期间:\s*(.*?)\s*;\s*角色:\s*(.*?)(?:\s*;\s*距今天约:\s*(\d+)\s*个月)?$"
PERIOD_PATTERN = (
    r"(?P<sy>20\d{2})\s*[年/\-\.]\s*(?P<sm>\d{1,2})\s*(?:月)?\s*[~～\-—]\s*"
    r"(?:(?P<ey>20\d{2})\s*[年/\-\.]\s*(?P<em>\d{1,2})\s*(?:月)?|(?P<ongoing>現在|今|present|current))"
)
PERSON_PATTERN = r"(?:氏名|name)\s*[:：]?\s*([A-Za-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}]{2,20})"
PROJECT_PATTERN = (
    r"([A-Za-z0-9\x{3040}-\x{30ff}\x{3400}-\x{9fff}・\-\(\)（）]{3,80}"
    r"(?:システム|系统|System|APP|App|プロジェクト|项目|案件))"
)
ROLE_PATTERN = r"(PM|PL|TL|SE|BSE|PG|担当|役割|ポジション)[^。;\n]{0,120}"

# --- fixed values: conversation memory ---------------------------------------------------------------
CONSTRAINT_WORDS = {
    "期間": ["期間", "工期", "いつから", "いつまで", "開始", "終了", "何月", "何日", "什么时候", "何時"],
    "比較": ["比較", "違い", "差分", "vs", "比", "对比", "比較して"],
    "件数": ["件数", "合計", "総数", "count", "何件", "いくつ"],
    "担当": ["担当", "役割", "ポジション", "職位", "职责"],
}
SCOPE_SHEET = r"(?i)(?:シート|sheet)\s*[「\"']?([\w\x{3040}-\x{30ff}\x{3400}-\x{9fff}\-]{1,48})"
SUBJECT_PATTERNS = [
    r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}A-Za-z0-9_/\-]{2,40})の(?:期間|工期|スケジュール|比較|件数|担当|役割)",
    r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}A-Za-z0-9_/\-]{2,40})(?:は|って|が|を|に|で)(?:いつから|いつまで|期間|工期|比較|担当|役割)",
    r"(?:について|関して)\s*([\x{3040}-\x{30ff}\x{3400}-\x{9fff}A-Za-z0-9_/\-]{2,40})",
    r"^([\x{3040}-\x{30ff}\x{3400}-\x{9fff}A-Za-z0-9_/\-]{2,24})(?:は|って)\??$",
]
FOLLOWUP_CUES = [
    "それ", "その", "この", "あれ", "哪个", "这个", "那个", "那", "つづき",
    "いつから", "いつまで", "什么时候", "どれくらい", "何件", "何月", "何日",
]
