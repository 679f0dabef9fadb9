"""Shaping of usage events before they are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import blank_to_null, safe_text, strip


def _name(c: Column) -> Column:
    return blank_to_null(strip(F.coalesce(c.cast("string"), F.lit(""))))


def usage_rows(events: DataFrame) -> DataFrame:
    """Caps, non-negative counts, default status."""
    c = F.col
    return events.select(
        "user_id",
        F.coalesce(c("conversation_id").cast("string"), F.lit("")).alias("conversation_id"),
        safe_text(c("question_text"), 8000).alias("question_text"),
        safe_text(c("answer_text"), 12000).alias("answer_text"),
        _name(c("intent")).alias("intent"),
        F.greatest(F.coalesce(c("retrieval_count"), F.lit(0)), F.lit(0)).alias("retrieval_count"),
        F.coalesce(_name(c("status")), F.lit("success")).alias("status"),
        F.when(F.length("error_message") > 0, safe_text(c("error_message"), 2000)).alias("error_message"),
        F.when(c("latency_ms") < 0, 0).otherwise(c("latency_ms")).alias("latency_ms"),
    )
