"""File sources: text-like files as blocks, fingerprints, object paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import clean_markdown, clean_text

MARKDOWN = ["md", "markdown"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def read_text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One text block per file; markdown loses its marks; files without text give no block."""
    raw = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("storage_path")
    )
    return text_blocks(raw)


def text_blocks(files: DataFrame) -> DataFrame:
    """S01 on a table of (value, file_name, ...): the block rows."""
    ext = extension(F.col("file_name"))
    text = F.when(ext.isin(MARKDOWN), clean_markdown(F.col("value"))).otherwise(clean_text(F.col("value")))
    null_text = F.lit(None).cast("string")
    md5 = F.col("file_md5") if "file_md5" in files.columns else F.md5("value")
    # a filter on the text itself would be worked out before it, and the text a second time
    return files.select(
        md5.alias("file_md5"), "file_name", F.lit(0).alias("block_index"), F.lit("text").alias("type"), F.explode_outer(F.array(text)).alias("text"),
        F.lit(None).cast("int").alias("page"), null_text.alias("section"), null_text.alias("sheet"),
        F.lit(None).cast("map<string,string>").alias("row_json"), F.lit("tika").alias("source_parser"),
        F.when(ext == "", "unknown").otherwise(ext).alias("file_type"), null_text.alias("image_path"),
    ).filter("text <> ''")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Files by content fingerprint, one row per distinct content."""
    files = spark.read.format("binaryFile").load(path).select(
        F.md5("content").alias("file_md5"), F.col("path").alias("storage_path"), F.col("length").alias("total_size"),
        F.col("modificationTime").alias("created_at"),
    )
    return registry(files, F.struct("created_at", "storage_path"))


def registry(files: DataFrame, order: Column) -> DataFrame:
    """The first file of each fingerprint and how many carry it."""
    rest = F.struct(*[c for c in files.columns if c != "file_md5"])
    one = files.groupBy("file_md5").agg(F.min_by(rest, order).alias("f"), F.count("*").alias("copies"))
    return one.select("file_md5", "f.*", "copies")


def document_path(user_id: Column, name: Column) -> Column:
    """S08."""
    return F.concat_ws("/", F.lit("documents"), user_id.cast("string"), name)


def analysis_path(user_id: Column, file_md5: Column, scope: Column, name: Column) -> Column:
    """Where the raw answer of a page analysis is kept."""
    return F.concat_ws("/", F.lit("analyses"), user_id.cast("string"), file_md5, scope, F.concat(name, F.lit(".json")))
