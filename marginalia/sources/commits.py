"""Several tables committed together, batch by batch (C08 with S07).

A batch writes its rows into a folder of its own under every table and, last of all, one row into the manifest. Readers take
batches of the manifest only, so a batch that broke between two tables is invisible, and one that is repeated replaces itself.
Of a file that comes in several batches the newest counts, in all tables alike, also where it has no rows any more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST, FILES = "_commits", "_files"


def write_batch(tables: dict[str, DataFrame], files: DataFrame, root: str, batch_id: int) -> None:
    """The rows of a batch, not yet visible. ``files`` names every file whose rows are replaced."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    files.select("file_md5").distinct().write.mode("overwrite").parquet(f"{root}/{FILES}/batch={batch_id}")


def publish(spark: SparkSession, root: str, batch_id: int) -> None:
    """Make a written batch visible."""
    spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1).write.mode("overwrite").parquet(f"{root}/{MANIFEST}/batch={batch_id}")


def commit(tables: dict[str, DataFrame], files: DataFrame, root: str, batch_id: int) -> None:
    write_batch(tables, files, root, batch_id)
    publish(files.sparkSession, root, batch_id)


def committed(spark: SparkSession, root: str) -> DataFrame | None:
    """(batch) of all visible batches, None before the first."""
    try:
        return spark.read.parquet(f"{root}/{MANIFEST}").select("batch").distinct()
    except AnalysisException:  # no batch yet
        return None


def all_rows(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """Rows of all visible batches, or of those before one, with `batch`."""
    seen = committed(spark, root)
    if seen is None:
        return None
    if before is not None:
        seen = seen.filter(F.col("batch") < before)
    if seen.isEmpty():
        return None
    return _read(spark, root, name, before).join(F.broadcast(seen), "batch", "left_semi")  # one number a batch


def _read(spark: SparkSession, root: str, name: str, before: int | None) -> DataFrame:
    """Folders of later batches are not read at all: one of them may be rewritten just now."""
    rows = spark.read.parquet(f"{root}/{name}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def current(spark: SparkSession, root: str, name: str, before: int | None = None, files: DataFrame | None = None) -> DataFrame | None:
    """Rows of the newest visible batch of every file (or of those in ``files``)."""
    versions = all_rows(spark, root, FILES, before)
    if versions is None:
        return None
    if files is not None:
        versions = versions.join(files.select("file_md5").distinct(), "file_md5", "left_semi")
    newest = versions.groupBy("file_md5").agg(F.max("batch").alias("batch"))
    return _read(spark, root, name, before).join(newest, ["file_md5", "batch"], "left_semi")
