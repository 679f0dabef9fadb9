"""Shards that each hold the mixture of all sources (law ``rows``: shard counts differ by one at most).

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - 1/2) / rows of its source.
All rows are then laid out by fractional rank, which interleaves the sources in proportion, and the line is cut into
shards of equal length. Neither ranking puts a source, or the whole table, into one task: hash values and fractional ranks
are spread evenly over [0, 1), so rows are ranked inside narrow buckets of them, and a small table of bucket counts tells
how many rows come before each bucket.

Defined cases: a null text has size 16 and checksum 0; a null source is a source of its own; a null doc_id is hashed as
such; repeated rows are laid out side by side in the shuffle and each gets a slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import stored

#: Rows that share a bucket, about.
BUCKET_ROWS = 4_000
LAW = "rows"


def _placed(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``name``: position from 1 of each row within ``keys`` in the order of ``bucket``, then ``order``."""
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)))
    return local.join(starts, [*keys, bucket]).withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before")


def assign(docs: DataFrame, shards: int = 40, seed: int = 17, source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard and slot of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stored(docs.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("_source"),
        (F.octet_length(body).cast("long") + 16).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    ), "sharding")
    sources = slim.groupBy("_source").agg(F.count("*").alias("_rows"))
    total = slim.count()
    buckets = max(1, total // BUCKET_ROWS)
    seeded = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    shuffled = slim.withColumn("_h", F.shiftrightunsigned(seeded, 11)) \
        .withColumn("_b", F.floor(F.col("_h") / F.lit(float(1 << 53)) * F.lit(buckets)).cast("int"))
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _placed(shuffled, ["_source"], "_b", [F.col("_h"), *ties], "_rank").drop("_b")
    line = ranked.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, "_source") \
        .withColumn("fraction", (F.col("_rank") - 0.5) / F.col("_rows")) \
        .withColumn("_all", F.lit(0)).withColumn("_f", F.floor(F.col("fraction") * F.lit(buckets)).cast("int"))
    position = _placed(line, ["_all"], "_f", [F.col("fraction"), F.col("_h"), F.col("_source"), *ties], "_pos")
    at, n = F.col("_pos") - 1, F.lit(max(total, 1))
    shard = F.expr(f"cast((_pos - 1) * {shards} div {max(total, 1)} as int)")
    first = F.ceil(F.col("shard").cast("decimal(38,0)") * n / F.lit(shards)).cast("long")
    return position.withColumn("shard", shard).withColumn("slot", at - first).select(
        "doc_id", F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias(source),
        "size", "text_crc32", "fraction", "shard", "slot")


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source")
