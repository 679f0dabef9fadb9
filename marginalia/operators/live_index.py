"""The term index kept up to date while files come in (R01 and S06 under M01).

A batch brings the new chunks of some files. Their old index rows are looked up by file, in the buckets these files fall into,
and count with a minus; the new ones count with a plus. What is stored per batch are the new rows and the signed changes of
document and collection frequencies and of the corpus' size, so statistics are sums of changes and no batch reads the corpus.
Rows, changes and files are committed together; a replayed batch reads only what came before it and writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.retrieval import KEY, index_columns
from marginalia.sources import commits
from marginalia.streaming.ingest import newest_versions

#: Buckets of files; an update reads those that its files are in.
BUCKETS = 64
ROWS, COUNTS = "index", "counts"


def _bucket():
    return F.pmod(F.xxhash64("file_md5"), F.lit(BUCKETS)).cast("int")


def _counts(rows: DataFrame, sign: int) -> DataFrame:
    """(term, df, cf) of index rows; the row without a term has the number of chunks and of tokens."""
    terms = rows.select(F.explode("tf").alias("p")).select(F.col("p.term").alias("term"), F.lit(sign).cast("long").alias("df"), (F.col("p.tf") * sign).cast("long").alias("cf"))
    sizes = rows.select(F.lit(None).cast("string").alias("term"), F.lit(sign).cast("long").alias("df"), (F.col("dl") * sign).cast("long").alias("cf"))
    return terms.unionByName(sizes)


def update(chunks: DataFrame, files: DataFrame, root: str, batch_id: int) -> None:
    """Replace the index rows of `files` (file_md5) by those of `chunks` (file_md5, chunk_id, text_content)."""
    spark = files.sparkSession
    # one folder a bucket, so that an update can skip the others; texts are dealt out, which take half of what their terms do, and
    # in a given number of parts, since the work is in the texts, not in their bytes
    dealt = chunks.select(*KEY, "text_content").withColumn("bucket", _bucket()).repartition(BUCKETS, "bucket")
    new = index_columns(dealt).select(*KEY, "dl", "tf", "bucket")
    path = f"{root}/{ROWS}/batch={batch_id}"
    new.write.mode("overwrite").partitionBy("bucket").parquet(path)
    # counted from what was written: the texts are taken apart once; with the schema given, also where there is no row
    changes = _counts(spark.read.schema(new.schema).parquet(path), 1)
    old = old_rows(spark, files, root, batch_id)
    if old is not None:
        changes = changes.unionByName(_counts(old, -1))
    changes = changes.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df <> 0 OR cf <> 0")
    commits.commit({COUNTS: changes}, files, root, batch_id)


def old_rows(spark: SparkSession, files: DataFrame, root: str, before: int) -> DataFrame | None:
    """The index rows that files have had before a batch."""
    touched = [r[0] for r in files.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    rows = commits.current(spark, root, ROWS, before, files)
    return None if rows is None else rows.filter(F.col("bucket").isin(touched))


def rows(spark: SparkSession, root: str) -> DataFrame:
    """The index: KEY, dl, tf of the current version of every file."""
    return commits.current(spark, root, ROWS).drop("batch", "bucket")


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """Document and collection frequency per term, from the changes alone."""
    sums = commits.all_rows(spark, root, COUNTS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return sums.filter("term IS NOT NULL AND df <> 0")


def corpus_size(spark: SparkSession, root: str) -> DataFrame:
    """(n_docs, avg_dl), from the changes alone."""
    sums = commits.all_rows(spark, root, COUNTS).filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), F.sum("cf").alias("cf"))
    return sums.select("n_docs", F.coalesce(F.try_divide("cf", "n_docs"), F.lit(0.0)).alias("avg_dl"))


def ingest_indexed(
    files: DataFrame, root: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], order: list[str] | None = None
) -> StreamingQuery:
    """M01 with its index: every micro-batch replaces the rows of its files; a file without chunks leaves the index."""
    def write(batch: DataFrame, batch_id: int) -> None:
        once = newest_versions(batch, order or [])  # its texts are read once, so they are not kept; the names are
        names = once.select("file_md5").persist()
        try:
            update(process(once.drop(*(order or []))), names, root, batch_id)
        finally:
            names.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
