"""Continuous ingest: validation, idempotence, chunk tables per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia import constants as C
from marginalia.operators.blocks import enrich
from marginalia.operators.chunking import pack_blocks
from marginalia.plans.joins import is_small
from marginalia.sources.files import text_blocks
from marginalia.sources.tables import current_rows, replace_files
from marginalia.streaming.monitor import utc_instant

REQUIRED = ["file_md5", "file_name", "storage_path", "user_id"]


def missing_fields(required: list[str] = REQUIRED) -> Column:
    """Names of the required fields a message lacks."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in required])
    )


def validated(requests: DataFrame) -> DataFrame:
    """`missing` is empty for good messages, else says why they go to the dead letters."""
    return requests.withColumn("missing", F.array_join(missing_fields(), ","))


def once_per_file(requests: DataFrame, ttl_days: int = C.DONE_TTL_DAYS) -> DataFrame:
    """One request per (user, file) while its marker lives; late by up to the marker's life."""
    live = requests.withColumn("at", utc_instant("ts")).withWatermark("at", f"{ttl_days} days")
    return live.dropDuplicatesWithinWatermark(["user_id", "file_md5"])


def first_requests(requests: DataFrame) -> DataFrame:
    """M02 in batch: the first request of each (user, file)."""
    rest = [c for c in requests.columns if c not in ("user_id", "file_md5")]
    first = F.min_by(F.struct(*rest), F.struct("ts", "event_id"))
    return requests.groupBy("user_id", "file_md5").agg(first.alias("r")).select("user_id", "file_md5", "r.*")


def append_new(spark: SparkSession, path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer behind `once_per_file`; a repeated batch changes nothing.

    Whether a key was seen before, and for how long that counts, is the stream's own state. Each batch
    owns one folder and reads no other.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def chunk_batch(files: DataFrame) -> DataFrame:
    """The batch path of ingest: files (file_md5, file_name, value) to chunk rows."""
    return pack_blocks(enrich(text_blocks(files).drop("file_name")))


def newest_versions(files: DataFrame, order: list[str]) -> DataFrame:
    """One row per file: the last by `order`, on ties the greatest row. Only rows of files that come twice are grouped."""
    rest = [c for c in files.columns if c != "file_md5"]
    twice = files.groupBy("file_md5").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("file_md5").alias("_twice"))
    if twice.isEmpty():
        return files
    known = F.broadcast(twice) if is_small(twice) else twice
    same = files.join(known, F.col("file_md5").eqNullSafe(F.col("_twice")), "left_semi")
    last = F.max_by(F.struct(*rest), F.struct(*order, *rest))
    one = same.groupBy("file_md5").agg(last.alias("r")).select("file_md5", "r.*").select(*files.columns)
    return files.join(known, F.col("file_md5").eqNullSafe(F.col("_twice")), "left_anti").unionByName(one)


def ingest(
    files: DataFrame, table: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] = chunk_batch, order: list[str] | None = None
) -> StreamingQuery:
    """Every micro-batch of files replaces the rows of its files in the chunk table.

    Of a file that comes twice in a batch the newest version counts, by the columns in `order`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        once = newest_versions(batch, order or []).persist()
        try:
            replace_files(process(once.drop(*(order or []))), once, table, batch_id)
        finally:
            once.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, table: str) -> DataFrame:
    return current_rows(spark, table)


def dead_letters(failed: DataFrame) -> DataFrame:
    """Failed requests with reason and position, as they go to the dead-letter topic."""
    keep = [c for c in ("file_md5", "user_id", "topic", "partition", "offset") if c in failed.columns]
    return failed.select(*keep, "reason", "attempts", F.to_json(F.struct(*failed.columns)).alias("message"))
