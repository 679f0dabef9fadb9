"""Online usage summaries, offline retrieval metrics, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import strip
from marginalia.plans.sequence import carry_forward, top_rows


def in_window(events: DataFrame, as_of: str, days: int, profile: str | None = None) -> DataFrame:
    """Events of the last `days` days before as_of."""
    start = F.expr(f"timestamp_ntz'{as_of}' - interval '{max(1, days)}' day")
    out = events.filter(F.col("created_at") >= start)
    return out.filter(F.col("selected_profile") == profile) if profile else out


def rank_percentile(df: DataFrame, keys: list[str], value: str, out: str, share: float = 0.95) -> DataFrame:
    """The value at sorted position clamp(int(share*n)-1), from a histogram of distinct values.

    The rows are counted per (key, value) before any shuffle; only the histogram is ordered.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = W.partitionBy(*keys)
    upto = by.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(by)
    wanted = F.greatest(F.floor(total * F.lit(share)), F.lit(1))
    return (
        hist.withColumn("_at", F.sum("_n").over(upto)).withColumn("_want", wanted)
        .filter("_at >= _want")
        .groupBy(*keys).agg(F.min(value).cast("double").alias(out))
    )


def daily_sketches(events: DataFrame, k: int = 200) -> DataFrame:
    """A04 at scale: per day a mergeable quantile sketch of the latency (rank error about 1.7 % at k = 200).

    Stored once; any window of days is a merge of its sketches (``rolled_up``), and no event is read again.
    """
    day = F.to_date("created_at").alias("day")
    return events.filter("latency_ms IS NOT NULL").groupBy(day).agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("long"), k).alias("sketch"), F.count("*").alias("n"))


def daily_intents(events: DataFrame) -> DataFrame:
    """A06 at scale: per day and intent how often it was asked."""
    return events.groupBy(F.to_date("created_at").alias("day"), intent_name(F.col("intent")).alias("intent")).agg(F.count("*").alias("n"))


def rolled_up(sketches: DataFrame, days: int = 7, share: float = 0.95) -> DataFrame:
    """Number and percentile of every window of ``days`` days that holds a day, from the daily sketches."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub("day", i))).alias("window_start")
    return sketches.select(starts, "sketch", "n").groupBy("window_start").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("s")).select(
        "window_start", "n", F.kll_sketch_get_quantile_bigint("s", F.lit(share)).alias("percentile"))


def top_intents_of(daily: DataFrame, days: int = 7, k: int = 12) -> DataFrame:
    """The k most frequent intents of every window of ``days`` days, ties by name."""
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_sub("day", i))).alias("window_start")
    sums = daily.select(starts, "intent", "n").groupBy("window_start", "intent").agg(F.sum("n").alias("n"))
    return top_rows(sums, ["window_start"], [F.col("n").desc(), F.col("intent")], k)


def online_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """A03-A05 per key: status counts, latency, retrieval rates."""
    s = F.coalesce(strip(F.col("status")), F.lit("unknown"))
    counts = events.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(s == v).alias(v) for v in ("success", "no_evidence", "error", "archived")],
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"),
        F.avg((F.col("retrieval_count") > 0).cast("double")).alias("retrieval_hit_rate"),
        F.avg((F.col("source_count") > 0).cast("double")).alias("with_sources_rate"),
    )
    p95 = rank_percentile(events, keys, "latency_ms", "p95_latency")
    return counts.join(p95, keys, "left").fillna(0.0, ["p95_latency"])


def intent_name(c: Column) -> Column:
    name = strip(F.coalesce(c, F.lit("unknown")))
    return F.when(name == "", "unknown").otherwise(name)


def top_intents(events: DataFrame, n: int = 12) -> DataFrame:
    """Most frequent intents, ties by first seen."""
    return (
        events.groupBy(intent_name(F.col("intent")).alias("intent"))
        .agg(F.count("*").alias("n"), F.min(F.struct("created_at", "event_id")).alias("_first"))
        .orderBy(F.col("n").desc(), "_first").limit(n).drop("_first")
    )


def daily_stats(events: DataFrame) -> DataFrame:
    """A07."""
    return events.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == v).alias(v) for v in ("success", "no_evidence", "error")],
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency"),
    )


def failing_samples(events: DataFrame, n: int = 20) -> DataFrame:
    """T03."""
    bad = events.filter(F.col("status").isin("no_evidence", "error"))
    return bad.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def run_overview(runs: DataFrame, metrics: DataFrame, cases: DataFrame, coverage: DataFrame) -> DataFrame:
    """Counts per run and the pass rate of its cases."""
    m = metrics.groupBy("run_id").agg(F.count("*").alias("n_metrics"))
    c = cases.groupBy("run_id").agg(
        F.count("*").alias("n_cases"), F.count_if("passed").alias("n_passed")
    )
    a = coverage.groupBy("run_id").agg(F.count("*").alias("n_coverage"))
    out = runs.join(m, "run_id", "left").join(c, "run_id", "left").join(a, "run_id", "left")
    out = out.fillna(0, ["n_metrics", "n_cases", "n_passed", "n_coverage"])
    rate = F.when(F.col("n_cases") > 0, F.col("n_passed") / F.col("n_cases")).otherwise(0.0)
    return out.withColumn("pass_rate", rate)


def coverage_rate(given: Column, indexed: Column, total: Column) -> Column:
    """A09."""
    return F.coalesce(given, F.try_divide(indexed, F.when(total > 0, total)), F.lit(0.0))


def replace_by(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of an incoming key replace the rows that key had."""
    fresh = incoming.select(*keys).distinct()
    return target.join(fresh, keys, "left_anti").unionByName(incoming)


def metric_trend(metrics: DataFrame, max_runs_per_task: int = 16384) -> DataFrame:
    """Metric against threshold and against the previous run that has the metric."""
    out = carry_forward(
        metrics, ["metric_key"], "run_id", F.col("metric_value"), "previous_value", max_runs_per_task, strict=True
    )
    return out.withColumn("passed", F.coalesce(F.col("metric_value") >= F.col("threshold"), F.lit(True))).withColumn(
        "regressed", F.coalesce(F.col("metric_value") < F.col("previous_value"), F.lit(False))
    )


def _contains_any(hay: Column, needles: Column) -> Column:
    low = F.lower(F.coalesce(hay, F.lit("")))
    return F.coalesce(
        F.exists(needles, lambda n: (strip(n) != "") & F.contains(low, F.lower(n))), F.lit(False)
    )


def is_relevant(hit: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Any given expectation holds; no expectation means not relevant."""
    return (
        F.coalesce(F.array_contains(expected["file_md5_any"], hit["file_md5"]), F.lit(False))
        | _contains_any(hit["file_name"], expected["file_name_any"])
        | _contains_any(hit["text_content"], expected["text_contains_any"])
        | F.coalesce(hit["score"] >= expected["min_score"], F.lit(False))
    )


def case_results(cases: DataFrame, judged: DataFrame) -> DataFrame:
    """A10 per case: `judged` has case_id, rank, relevant."""
    agg = judged.groupBy("case_id").agg(
        F.count("*").alias("retrieved"), F.count_if("relevant").alias("relevant_in_topk"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rel_rank"),
    )
    out = cases.join(agg, "case_id", "left").fillna(0, ["retrieved", "relevant_in_topk"])
    hit = F.col("first_rel_rank").isNotNull()
    return (
        out.withColumn("hit_at_k", hit)
        .withColumn("recall_at_k", hit.cast("double"))
        .withColumn("mrr", F.coalesce(1.0 / F.col("first_rel_rank"), F.lit(0.0)))
    )


def retrieval_summary(results: DataFrame) -> DataFrame:
    """A10 over all cases."""
    return results.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("hit_at_k").cast("double")), 4).alias("hit_at_k"),
        F.round(F.avg("recall_at_k"), 4).alias("recall_at_k"),
        F.round(F.avg("mrr"), 4).alias("mrr"),
        F.round(F.avg("first_rel_rank"), 4).alias("first_rel_rank_avg"),
    )


def report_rows(results: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """Per-case rows with their best hits nested."""
    best = hits.filter(F.col("rank") <= top).select(
        "case_id", "rank", "file_name", "file_md5", "score",
        F.left(F.coalesce("text_content", F.lit("")), F.lit(120)).alias("text_preview"),
    )
    nested = best.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "file_name", "file_md5", "score", "text_preview"))).alias("top_hits")
    )
    return results.join(nested, "case_id", "left")


def parse_cases(lines: DataFrame) -> DataFrame:
    """JSON lines (line_no, value) to cases; `error` names what is wrong with a bad line."""
    schema = (
        "id string, query string, top_k string, expected struct<file_md5_any: array<string>, "
        "file_name_any: array<string>, text_contains_any: array<string>, min_score: double>"
    )
    value = strip(F.col("value"))
    rows = lines.filter((value != "") & ~value.startswith("#"))
    raw = rows.select("line_no", F.from_json(value, schema).alias("c"), F.get_json_object(value, "$.expected").alias("e"))
    query = strip(F.coalesce("c.query", F.lit("")))
    top_k = F.col("c.top_k").try_cast("int")
    return raw.select(
        "line_no",
        F.coalesce(F.nullif("c.id", F.lit("")), F.concat(F.lit("line-"), F.col("line_no"))).alias("case_id"),
        query.alias("query"),
        F.when(F.coalesce(top_k, F.lit(0)) == 0, 10).otherwise(top_k).alias("top_k"),
        F.col("c.expected").alias("expected"),
        F.when(query == "", "query is required")
        .when(F.col("e").isNotNull() & ~F.col("e").startswith("{"), "expected must be object").alias("error"),
    )


def totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """A22."""
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def file_counts(files: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Row counts per file over several tables, zero where a file has none.

    Every table is counted before the union, so the shuffle carries one row per file and table.
    """
    counted = None
    for kind, df in parts.items():
        one = df.groupBy("file_md5").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        counted = one if counted is None else counted.unionByName(one)
    wide = counted.groupBy("file_md5").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in parts]
    )
    return files.join(wide, "file_md5", "left").fillna(0, list(parts))


def upload_progress(parts: DataFrame, totals_df: DataFrame) -> DataFrame:
    """Distinct parts against the declared total."""
    got = parts.groupBy("file_md5").agg(F.countDistinct("chunk_index").alias("received"))
    out = totals_df.join(got, "file_md5", "left").fillna(0, ["received"])
    return out.withColumn("progress", F.col("received") / F.col("total_chunks")).withColumn(
        "mergeable", F.col("received") == F.col("total_chunks")
    )


def missing_parts(parts: DataFrame, totals_df: DataFrame) -> DataFrame:
    """Part numbers that never arrived."""
    wanted = totals_df.select(
        "file_md5", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_index")
    )
    return wanted.join(parts, ["file_md5", "chunk_index"], "left_anti")


def upload_bitmaps(parts: DataFrame) -> DataFrame:
    """How many parts were received, one row per file and bitmap bucket.

    The set bits are counted as distinct positions: a bitmap in hand takes 4 KB a file, however few its parts.
    """
    i = F.col("chunk_index").cast("long") + 1
    return parts.groupBy("file_md5", F.bitmap_bucket_number(i).alias("bucket")).agg(
        F.count_distinct(F.bitmap_bit_position(i)).alias("received")
    )


def last_messages(messages: DataFrame, n: int = C.HISTORY_KEEP) -> DataFrame:
    """The newest n messages per conversation."""
    return top_rows(messages, ["conversation_id"], [F.col("seq").desc()], n, "age")


def conversation_counts(messages: DataFrame) -> DataFrame:
    """A24."""
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.max("ts").alias("last_message_time")
    )


def in_iso_range(ts_text: Column, start: str | None, end: str | None) -> Column:
    """Inclusive comparison of ISO strings; messages without a time stay."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts_text >= start)
    if end:
        ok = ok & (ts_text <= end)
    return F.coalesce(ts_text, F.lit("")).eqNullSafe(F.lit("")) | ok
