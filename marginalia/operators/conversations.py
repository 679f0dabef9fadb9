"""Conversation memory and the experience timeline."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions import questions as Q
from marginalia.functions import text as X
from marginalia.operators.acl import first_readable
from marginalia.plans.sequence import running_count, top_rows, with_halo


def with_memory(messages: DataFrame, turns: int = C.MEMORY_TURNS) -> DataFrame:
    """User turns with the newest subject, constraint and scope of the four user turns before,
    and the rewritten text of follow-ups."""
    user = running_count(messages.filter("role = 'user'"), ["conversation_id"], "seq", F.lit(1), "_n")
    user = user.withColumn("turn_no", F.col("_n") - 1).drop("_n")
    c = F.col("content")
    user = user.withColumns({"subject": Q.memory_subject(c), "constraint": Q.memory_constraint(c), "scope": Q.memory_scope(c)})
    w = W.partitionBy("conversation_id", "seg").orderBy("turn_no").rangeBetween(-turns, -1)
    near = with_halo(user, "turn_no", turns, 0)
    for slot in ("subject", "constraint", "scope"):
        old = F.last(F.nullif(F.col(slot), F.lit("")), ignorenulls=True).over(w)
        near = near.withColumn(f"old_{slot}", F.coalesce(old, F.lit("")))
    mine = near.filter("own").drop("own", "seg")
    n_entities = F.size(Q.entity_signals(c))
    follow = Q.is_followup(c, n_entities, F.col("subject"))
    pick = lambda s: F.when(F.col(s) != "", F.col(s)).otherwise(F.col(f"old_{s}"))
    text = F.when(follow, Q.with_memory(c, F.col("old_subject"), pick("constraint"), pick("scope"))).otherwise(c)
    return mine.withColumn("is_followup", follow).withColumn("effective_text", text)


def _python_pattern(p: str) -> str:
    """The shared pattern notation \\x{hhhh} in Python's spelling."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", p)


def experience_items(chunks: DataFrame, as_of_ym: int) -> DataFrame:
    """Every period in a chunk with its surroundings, project and role; first of each kept per file.

    Match positions are needed for the window around a period, hence a batch function; everything
    else is columns. The person is the first name found in the file.
    """
    schema = (
        "file_md5 string, chunk_id int, match_no int, start_y int, start_m int, end_y int, end_m int, period_text string, "
        "around string"
    )
    period = re.compile(_python_pattern(C.PERIOD_PATTERN), re.IGNORECASE)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for md5, chunk, text in zip(pdf["file_md5"], pdf["chunk_id"], pdf["text_content"]):
                for no, m in enumerate(period.finditer(text)):
                    ey, em = (0, 0) if m["ongoing"] else (int(m["ey"]), int(m["em"]))
                    around = f"{text[max(0, m.start() - 80):m.start()]} {text[m.end():m.end() + 240]}"
                    out.append((md5, chunk, no, int(m["sy"]), int(m["sm"]), ey, em, m[0], around))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    narrow = chunks.select("file_md5", F.col("chunk_id").cast("int").alias("chunk_id"), "text_content")
    may = narrow.filter(F.col("text_content").rlike(r"20\d{2}\s*[年/\-.]"))
    rows = may.mapInPandas(find, schema)
    flat = X.collapse_ws(F.col("around"))
    project = F.regexp_extract(flat, "(?i)" + C.PROJECT_PATTERN, 1)
    rest = F.left(X.strip(F.regexp_replace(flat, "[;|]+", " ")), F.lit(80))
    project = F.coalesce(X.blank_to_null(F.left(project, F.lit(255))), X.blank_to_null(rest), F.lit(C.UNNAMED_PROJECT))
    role = X.blank_to_null(F.left(X.strip(F.regexp_extract(flat, f"(?i)({C.ROLE_PATTERN})", 1)), F.lit(255)))
    rows = rows.select(
        "file_md5", "chunk_id", "match_no", project.alias("project_name"), role.alias("role_summary"),
        X.ym(F.col("start_y"), F.col("start_m")).alias("start_ym"),
        F.when(F.col("end_y") == 0, as_of_ym).otherwise(X.ym(F.col("end_y"), F.col("end_m"))).alias("end_ym"),
        F.left("period_text", F.lit(64)).alias("period_text"), F.left("around", F.lit(500)).alias("evidence_text"),
    )
    first = F.struct("chunk_id", "match_no")
    items = rows.groupBy("file_md5", "project_name", "start_ym", "end_ym").agg(
        F.min_by(F.struct("role_summary", "period_text", F.col("chunk_id").alias("source_chunk_id"), "evidence_text"), first).alias("r")
    ).select("file_md5", "project_name", "start_ym", "end_ym", "r.*")
    name = F.regexp_extract("text_content", C.PERSON_PATTERN, 1)
    who = narrow.withColumn("n", X.blank_to_null(name)).filter("n is not null").groupBy("file_md5").agg(F.min_by("n", "chunk_id").alias("person_name"))
    return items.join(who, "file_md5", "left")


def backfill_files(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with chunks but without experience rows."""
    return chunks.select("file_md5").distinct().join(items.select("file_md5").distinct(), "file_md5", "left_anti")


def recent_items(
    items: DataFrame, users: DataFrame, files: DataFrame, top_n: Column | int, as_of: Column, distance: Column
) -> DataFrame:
    """The newest items a user may see as timeline rows (1 to 20 of them).

    users: user_id, tokens; files: file_md5, file_tokens. Items are cut to the 20 newest per token
    before they meet the users.
    """
    order = [F.col("end_ym").desc(), F.col("start_ym").desc(), F.col("id").desc()]
    key = ["user_id", "file_md5", "project_name", "start_ym", "end_ym"]
    n = F.least(F.greatest(F.lit(top_n) if isinstance(top_n, int) else top_n, F.lit(1)), F.lit(20))
    seen = first_readable(items, users, files, [], order, 20, key).withColumn("_n", n)
    best = top_rows(seen, ["user_id"], order, F.col("_n"), at_most=20).drop("_n")
    text = F.concat(
        F.lit(f"{C.TIMELINE_MARK} 项目: "), "project_name", F.lit(" ; 期间: "), F.coalesce("period_text", F.lit("")), F.lit(" ; 角色: "),
        F.coalesce(X.blank_to_null(F.col("role_summary")), F.lit(C.UNKNOWN_ROLE)),
    )
    ago = F.concat(F.lit(" ; 距今天约: "), X.months_since(F.col("end_ym"), as_of).cast("string"), F.lit(" 个月"))
    return best.withColumn("text_content", F.concat(text, F.when(distance & (F.col("end_ym") > 0), ago).otherwise(""))).withColumn("score", F.lit(9.0))


def timeline_answer(hits: DataFrame, n: int = 3) -> DataFrame:
    """The first n timeline rows of a question, parsed back."""
    pat = C.TIMELINE_TEXT
    part = lambda i: X.strip(F.regexp_extract("text_content", pat, i))
    rows = hits.filter(F.col("text_content").startswith(C.TIMELINE_MARK) & F.col("text_content").rlike(pat))
    rows = rows.select("query_id", "rank", part(1).alias("project"), part(2).alias("period"), part(3).alias("role"), part(4).alias("distance"))
    return top_rows(rows, ["query_id"], [F.col("rank")], n, "nth").drop("rank")
