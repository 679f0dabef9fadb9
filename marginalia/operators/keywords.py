"""Keyword tables: defaults with overrides (N03), and classification by such a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.questions import first_intent
from marginalia.functions.text import strip
from marginalia.plans.joins import contains_matches


def default_keywords(spark: SparkSession) -> DataFrame:
    rows = [(cat, w) for cat, words in C.INTENT_KEYWORDS.items() for w in words]
    return spark.createDataFrame(rows, "category string, term string")


def merge_keywords(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """A category with at least one usable override takes the overrides, else its defaults."""
    term = F.lower(strip(F.col("term")))
    known = defaults.select("category").distinct()
    usable = overrides.select("category", term.alias("term")).filter("term <> ''").distinct().join(
        known, "category", "left_semi"
    )
    kept = defaults.join(usable.select("category").distinct(), "category", "left_anti")
    return kept.select("category", "term").unionByName(usable)


def intents(questions: DataFrame, table: DataFrame) -> DataFrame:
    """The intent of every question (question_id, question) by a keyword table of any size."""
    text = F.lower(strip(F.coalesce("question", F.lit(""))))
    hit = contains_matches(questions, text, table, ["question_id"])
    kinds = [f"{k}_QUERY_KEYS" for k in ("COMPARE", "STATISTICS", "SCHEDULE", "LAYOUT", "FLOW", "TIMELINE")]
    counts = hit.join(table.filter(F.col("category").isin(kinds)), "term").groupBy("question_id").agg(
        *[F.count_if(F.col("category") == k).alias(k) for k in kinds]
    )
    n = [F.coalesce(k, F.lit(0)) for k in kinds]
    chosen = first_intent(n[0] > 0, n[1] > 0, n[2] > 0, n[3], n[4], n[5] > 0)
    return questions.select("question_id").join(counts, "question_id", "left").select("question_id", chosen.alias("intent"))
