"""Question understanding as column expressions: terms, entities, anchors, intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import (
    any_contained, bind, count_contained, keep_first, match_key, strip,
)

LATIN_31 = "([A-Za-z][A-Za-z0-9_-]{1,31})"
LATIN_32 = "([A-Za-z][A-Za-z0-9_-]{1,32})"
IDENTIFIER = "^(?:" + "|".join(C.IDENTIFIER_PATTERNS) + ")$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stripped(q: Column) -> Column:
    return strip(F.coalesce(q, F.lit("")))


def query_keywords(q: Column) -> Column:
    """CJK runs, then Latin tokens, first six distinct."""
    q = _stripped(q)
    both = F.concat(_all(q, f"([{C.CJK}]{{2,16}})"), _all(q, LATIN_31))
    return F.slice(F.array_distinct(both), 1, 6)


def relation_terms(q: Column) -> Column:
    """F15."""
    terms = F.transform(F.split(F.coalesce(q, F.lit("")), C.RELATION_TERM_SPLIT), lambda t: F.lower(strip(t)))
    noise = _words(C.RELATION_STOP_TERMS + [h.lower() for h in C.RELATION_QUERY_HINTS])
    return F.filter(
        terms, lambda t: (t != "") & ~F.array_contains(noise, t) & ~t.rlike(r"\A[a-z0-9]\z")
    )


def schedule_keywords(q: Column) -> Column:
    """F16."""
    q = _stripped(q)
    both = F.concat(_all(q, f"([{C.CJK}]{{2,24}})"), _all(q, LATIN_32))
    return F.slice(F.array_except(F.array_distinct(both), _words(C.SCHEDULE_STOP_WORDS)), 1, 8)


def normalize_query(q: Column) -> Column:
    """F17."""
    t = F.regexp_replace(_stripped(q), r"[、。,.!?！？:：;；\[\]{}<>\"'`]+", " ")
    return F.regexp_replace(t, f"{C.WS}+", " ")


def _entity_term(raw: Column) -> Column:
    t = F.regexp_replace(strip(raw), C.HONORIFIC_TAIL, "")
    t = F.regexp_replace(t, C.PARTICLE_TAIL, "")
    return strip(F.regexp_replace(t, rf"({C.WS}|[-_|])+", ""))


def entity_signals(q: Column) -> Column:
    """array of struct(term, entity_type, confidence, source), best ten first."""
    q = _stripped(q)

    def tagged(arr, source):
        return F.transform(arr, lambda x: F.struct(_entity_term(x).alias("term"), F.lit(source).alias("source")))

    found = F.concat(
        tagged(_all(q, C.ENTITY_BEFORE_PARTICLE), "ja_pattern"),
        tagged(_all(q, "([A-Za-z][A-Za-z0-9_-]{2,32})"), "latin_token"),
    )
    found = keep_first(F.filter(found, lambda e: e["term"] != ""), lambda e: F.lower(e["term"]))
    generic = _words([t.lower() for t in C.INTENT_KEYWORDS["GENERIC_TOPIC_TERMS"]])
    named = rf"^(?:[A-Za-z][A-Za-z0-9_-]{{2,32}}|[A-Z]{{2,}}[0-9_-]{{1,16}}|[{C.HAN}]{{2,16}})$"

    def classify(e, i):
        is_generic = F.array_contains(generic, F.lower(e["term"]))
        is_named = ~is_generic & e["term"].rlike(named)
        conf = (
            F.when(is_generic, 0.2)
            .when(is_named & (e["source"] == "ja_pattern"), 0.74)
            .when(is_named, 0.68)
            .otherwise(0.45)
        )
        return F.struct(
            (-conf).alias("neg"), i.alias("pos"), e["term"].alias("term"),
            F.when(is_named, "named").otherwise("topic").alias("entity_type"),
            conf.alias("confidence"), e["source"].alias("source"),
        )

    ranked = F.slice(F.array_sort(F.transform(found, classify)), 1, 10)
    return F.transform(
        ranked,
        lambda r: F.struct(*[r[n].alias(n) for n in ("term", "entity_type", "confidence", "source")]),
    )


def entities(signals: Column) -> Column:
    return F.slice(signals["term"], 1, 8)


def is_identifier(token: Column) -> Column:
    return token.rlike(IDENTIFIER)


def anchor_tokens(q: Column, profile: Column) -> Column:
    """up to eight tokens after stop words; design keeps identifiers."""
    raw = _stripped(q)
    plain = F.regexp_replace(F.lower(raw), r"[、。,.!?！？:：;；()\[\]{}<>「」『』\"'`]+", " ")
    found = F.concat(
        _all(raw, f"({C.DOTTED_TOKEN})"), _all(plain, LATIN_31), _all(plain, f"([{C.CJK}]{{2,24}})")
    )
    design = profile == "design"
    base, extra = _words(C.ANCHOR_STOP_WORDS), _words(C.DESIGN_STOP_WORDS)
    kept = F.filter(
        F.array_distinct(found),
        lambda t: (design & is_identifier(t))
        | ~(F.array_contains(base, t) | (design & F.array_contains(extra, t))),
    )
    return F.slice(kept, 1, 8)


def _anchor_form(token: Column) -> Column:
    t = F.regexp_replace(strip(token), C.HONORIFIC_TAIL, "")
    t = F.regexp_replace(t, C.STRONG_PARTICLE_TAIL, "")
    for suffix in C.STRONG_SUFFIXES:
        t = F.regexp_replace(t, suffix, "")
    return strip(t)


def strong_anchors(q: Column, profile: Column) -> Column:
    """up to four names or identifiers the evidence has to mention."""
    anchors = anchor_tokens(q, profile)
    names = F.array_distinct(_all(_stripped(q), C.NAME_BEFORE_PARTICLE))
    forms = F.transform(
        bind(anchors, lambda a: F.concat(F.reverse(F.array_except(names, a)), a)), _anchor_form
    )
    design = profile == "design"
    base, extra = _words(C.STRONG_STOP_WORDS), _words(C.DESIGN_STOP_WORDS)
    shape = rf"^(?:[{C.CJK}]{{2,12}}|[A-Za-z0-9_-]{{3,32}})$"

    def strong(t):
        stopped = F.array_contains(base, t) | (design & F.array_contains(extra, t))
        question = any_contained(t, C.QUESTION_FRAGMENTS) | t.rlike(C.QUESTION_HEAD)
        plain = ~stopped & ~question & ~t.rlike(f"^[{C.HIRAGANA}]{{2,24}}$") & t.rlike(shape)
        return (t != "") & ((design & is_identifier(t)) | plain)

    return F.slice(F.filter(forms, strong), 1, 4)


def anchor_variants(token: Column) -> Column:
    """spellings under which an anchor may occur in evidence."""
    t = strip(token)
    stems = F.array(
        t,
        *[
            F.when(t.endswith(s) & (F.length(t) > len(s)), F.left(t, F.length(t) - len(s)))
            for s in C.TRIMMED_SUFFIXES
        ],
    )

    def spellings(s):
        forms = F.array(
            s, F.translate(s, C.SIMPLIFIED, C.TRADITIONAL), F.translate(s, C.TRADITIONAL, C.SIMPLIFIED)
        )
        return F.concat(forms, F.transform(forms, match_key))

    return F.filter(
        F.array_distinct(F.flatten(F.transform(F.array_compact(stems), spellings))), lambda v: v != ""
    )


def top_n(q: Column) -> Column:
    """F21."""
    t = F.lower(F.coalesce(q, F.lit("")))
    n = F.regexp_extract(t, C.TOP_N_PATTERN, 1).try_cast("int")
    return (
        F.when(n.isNotNull(), F.least(n, F.lit(20)))
        .when(t.contains("三个") | t.contains("三個"), 3)
        .when(t.contains("两个") | t.contains("兩個"), 2)
        .when(t.contains("一个") | t.contains("一個"), 1)
        .otherwise(3)
    )


def intent(q: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """One intent per question, fixed priority."""
    kw = keywords or C.INTENT_KEYWORDS
    t = F.lower(_stripped(q))

    def has(name):
        return any_contained(t, kw[name])

    return first_intent(
        has("COMPARE_QUERY_KEYS"), has("STATISTICS_QUERY_KEYS"), has("SCHEDULE_QUERY_KEYS"),
        count_contained(t, kw["LAYOUT_QUERY_KEYS"]), count_contained(t, kw["FLOW_QUERY_KEYS"]), has("TIMELINE_QUERY_KEYS"),
    )


def first_intent(compare: Column, statistics: Column, schedule: Column, layout_hits: Column, flow_hits: Column, timeline: Column) -> Column:
    """The priority of the intents, given what a question contains."""
    return (
        F.when(compare, "compare_query")
        .when(statistics, "statistics_query")
        .when(schedule, "schedule_query")
        .when((layout_hits > 0) & (layout_hits >= flow_hits), "layout_query")
        .when(flow_hits > 0, "flow_query")
        .when(timeline, "timeline_query")
        .otherwise("fact_lookup")
    )


def ask_distance(q: Column) -> Column:
    return any_contained(F.lower(F.coalesce(q, F.lit(""))), C.ASK_DISTANCE_KEYS)


def rewritten_query(
    q: Column, intent_col: Column, signals: Column, profile_terms: Column,
    keywords: dict[str, list[str]] | None = None,
) -> Column:
    """Normalised question plus profile and intent expansion terms."""
    kw = keywords or C.INTENT_KEYWORDS
    raw = _stripped(q)
    no_anchor = F.size(signals) == 0
    base = (
        F.when((intent_col == "flow_query") & no_anchor & raw.rlike(C.FLOW_PRESENTATION), C.FLOW_REWRITE)
        .when((intent_col == "layout_query") & no_anchor & raw.rlike(C.LAYOUT_PRESENTATION), C.LAYOUT_REWRITE)
        .otherwise(strip(normalize_query(q)))
    )
    terms = strip(F.coalesce(profile_terms, F.lit("")))
    base = F.when((terms != "") & ~F.contains(base, terms), F.concat(base, F.lit(" "), terms)).otherwise(base)
    for name, words in (
        ("schedule_query", C.SCHEDULE_EXPANSION),
        ("layout_query", " ".join(sorted(kw["LAYOUT_QUERY_KEYS"]))),
        ("flow_query", " ".join(sorted(kw["FLOW_QUERY_KEYS"]))),
    ):
        base = F.when(
            (intent_col == name) & ~base.contains(words), F.concat(base, F.lit(" " + words))
        ).otherwise(base)
    return strip(base)


def relation_search_wanted(q: Column, intent_col: Column) -> Column:
    """Flow questions need one strict relation word, others two."""
    hits = count_contained(F.lower(F.coalesce(q, F.lit(""))), C.INTENT_KEYWORDS["STRICT_RELATION_KEYS"])
    return F.when(intent_col == "flow_query", hits >= 1).otherwise(hits >= 2)


def is_relation_query(q: Column) -> Column:
    return any_contained(F.lower(F.coalesce(q, F.lit(""))), [h.lower() for h in C.RELATION_QUERY_HINTS])


def is_presentation_query(q: Column) -> Column:
    return any_contained(F.lower(F.coalesce(q, F.lit(""))), C.INTENT_KEYWORDS["RELATION_PRESENTATION_KEYS"])


def is_visual_request(q: Column) -> Column:
    return any_contained(F.lower(F.coalesce(q, F.lit(""))), C.INTENT_KEYWORDS["VISUAL_DIAGRAM_REQUEST_KEYS"])


def evidence_preference(q: Column) -> Column:
    """Relation, text or mixed."""
    kw = C.INTENT_KEYWORDS
    t = F.lower(F.coalesce(q, F.lit("")))
    related = any_contained(t, kw["STRICT_RELATION_KEYS"] + kw["FLOW_QUERY_KEYS"])
    explained = any_contained(t, kw["TEXT_EXPLANATION_KEYS"])
    return (
        F.when(any_contained(t, kw["LAYOUT_QUERY_KEYS"]), "text")
        .when(related & explained, "mixed")
        .when(related, "relation")
        .otherwise("text")
    )


def relation_type(line: Column) -> Column:
    """F32: first keyword group in fixed order, else an arrow, else null."""
    t = F.lower(F.coalesce(line, F.lit("")))
    groups = [F.when(any_contained(t, words), name) for name, words in C.RELATION_KEYWORDS.items()]
    return F.coalesce(*groups, F.when(any_contained(t, C.ARROWS), C.CONNECT))


def clean_line(line: Column) -> Column:
    t = F.regexp_replace(_stripped(line), f"{C.WS}+", " ")
    return F.regexp_replace(t, r"\A[\[\]()（）]+|[\[\]()（）]+\z", "")


def likely_node(line: Column) -> Column:
    """F33."""
    return bind(
        clean_line(line),
        lambda t: F.length(t).between(2, 80)
        & ~t.rlike(C.NUMBER_LINE)
        & ~any_contained(F.lower(t), ["http://", "https://", "www."])
        & t.rlike(f"[A-Za-z{C.CJK}]")
        & relation_type(t).isNull(),
    )


def memory_subject(text: Column) -> Column:
    """Subject slot, '' when none."""
    t = _stripped(text)
    hits = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in C.SUBJECT_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def memory_constraint(text: Column) -> Column:
    t = _stripped(text)
    return F.coalesce(
        *[F.when(any_contained(t, words), label) for label, words in C.CONSTRAINT_WORDS.items()], F.lit("")
    )


def memory_scope(text: Column) -> Column:
    t = _stripped(text)
    sheet = F.regexp_extract(t, C.SCOPE_SHEET, 1)
    return (
        F.when(sheet != "", F.concat(F.lit("シート:"), sheet))
        .when(t.contains("スケジュール"), "スケジュール")
        .when(t.contains("履歴書") | t.contains("経歴書"), "履歴書")
        .otherwise("")
    )


def is_followup(q: Column, n_entities: Column, subject: Column) -> Column:
    t = _stripped(q)
    short = F.length(t) <= 24
    return (t != "") & (subject == "") & (n_entities == 0) & (short | any_contained(t, C.FOLLOWUP_CUES))


def with_memory(q: Column, subject: Column, constraint: Column, scope: Column) -> Column:
    """The follow-up with its remembered header."""
    topic = (
        F.when((subject != "") & (constraint != ""), F.concat(subject, F.lit("の"), constraint))
        .when(subject != "", subject)
        .when(constraint != "", constraint)
    )
    header = F.concat_ws(" / ", F.when(scope != "", scope), topic)
    return F.when(header == "", q).otherwise(F.concat(header, F.lit(" について: "), q))
