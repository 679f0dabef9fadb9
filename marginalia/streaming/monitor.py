"""Event-time aggregations over live logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia import constants as C

STEPS = [
    (C.STATUS_UPLOADING, C.STATUS_MERGED), (C.STATUS_MERGED, C.STATUS_PROCESSING),
    (C.STATUS_PROCESSING, C.STATUS_DONE), (C.STATUS_PROCESSING, C.STATUS_FAILED),
    (C.STATUS_FAILED, C.STATUS_PROCESSING), (C.STATUS_DONE, C.STATUS_PROCESSING),
]


def utc_instant(col: str) -> Column:
    """A naive UTC time as an instant; watermarks need instants, whatever the session's time zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})"))


def utc_wall(col: Column) -> Column:
    """An instant as naive UTC time."""
    seconds = (F.unix_micros(col).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def legal_step(before: Column, after: Column) -> Column:
    """May a file go from one status to the other (a first status is always legal)."""
    ok = F.lit(False)
    for a, b in STEPS:
        ok = ok | ((before == a) & (after == b))
    return before.isNull() | (before == after) | ok


def latest_status(changes: DataFrame) -> DataFrame:
    """The newest status per file; works on a stream in update mode."""
    at = F.struct("ts", "event_id")
    return changes.groupBy("file_md5").agg(F.max_by("status", at).alias("status"), F.max("ts").alias("changed_at"), F.count("*").alias("changes"))


def daily_monitor(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Status counts, rates and latency per day."""
    return _monitor(events, F.window("at", "1 day"), late)


def weekly_monitor(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The same over seven days, sliding by one."""
    return _monitor(events, F.window("at", "7 days", "1 day"), late)


def _monitor(events: DataFrame, window: Column, late: str) -> DataFrame:
    events = events.withColumn("at", utc_instant("created_at")).withWatermark("at", late)
    bad = lambda s: F.avg((F.col("status") == s).cast("double"))
    return events.groupBy(window.alias("w")).agg(
        F.count("*").alias("total"), bad("error").alias("error_rate"), bad("no_evidence").alias("no_evidence_rate"),
        F.avg("latency_ms").alias("avg_latency"),
    ).select(utc_wall(F.col("w.start")).alias("window_start"), "total", "error_rate", "no_evidence_rate", "avg_latency")


def idle_sessions(events: DataFrame, idle: str = f"{C.IDLE_SECONDS} seconds", late: str = "1 hour") -> DataFrame:
    """Connections as sessions that end after an idle hour."""
    events = events.withColumn("at", utc_instant("ts")).withWatermark("at", late)
    return events.groupBy("user_id", F.session_window("at", idle).alias("s")).agg(F.count("*").alias("events")).select(
        "user_id", utc_wall(F.col("s.start")).alias("opened_at"), utc_wall(F.col("s.end")).alias("idle_at"), "events"
    )


def upload_counts(parts: DataFrame) -> DataFrame:
    """Distinct parts received per file; the state of a file is the set of its part numbers."""
    return parts.groupBy("file_md5").agg(F.size(F.collect_set("chunk_index")).cast("long").alias("received"))


def archive_rows(messages: DataFrame, archived: DataFrame, as_of: Column) -> DataFrame:
    """Messages of conversations not archived yet; unreadable times become as_of."""
    fresh = messages.join(archived.select("conversation_id"), "conversation_id", "left_anti")
    return fresh.withColumn("ts", F.coalesce(F.col("ts_text").try_cast("timestamp_ntz"), as_of)).drop("ts_text")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update", endless: bool = False) -> StreamingQuery:
    """Write the rows that a batch changed into the batch's own folder; a repeated batch replaces it.

    A stream with processing-time state never runs dry; start it `endless` and stop it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    out = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime="1 second") if endless else out.trigger(availableNow=True)).start()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that `to_table` writes: the rows of the last batch that changed their key."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")
