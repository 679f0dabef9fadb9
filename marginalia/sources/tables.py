"""Table sinks and scans: relational tables, keyed upsert, replace-by-file, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc_options(url: str, table: str, column: str, low: int, high: int, partitions: int) -> dict[str, str]:
    return {
        "url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
        "numPartitions": str(partitions), "fetchsize": "10000",
    }


def read_table(spark: SparkSession, **options) -> DataFrame:
    """A relational table in parallel ranges of a numeric column; filters are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def write_table(df: DataFrame, url: str, table: str, connections: int = 16) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(connections), batchsize="5000").mode("append").save()


def merge_by_key(target: DataFrame, incoming: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Upsert; an incoming row replaces the row of its key, the last incoming row wins."""
    if order is not None:
        rest = [c for c in incoming.columns if c not in keys]
        incoming = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def replace_files(rows: DataFrame, files: DataFrame, path: str, batch_id: int) -> None:
    """All rows of the named files are replaced by `rows` (none, where a file has none).

    Every batch writes its own folder and can be repeated after a failure; readers take the newest
    batch of each file. `files` names the replaced files, so a file may also become empty.
    """
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    files.select("file_md5").distinct().write.mode("overwrite").parquet(f"{path}/files/batch={batch_id}")


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest batch of every file."""
    newest = spark.read.parquet(f"{path}/files").groupBy("file_md5").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/rows").join(newest, ["file_md5", "batch"], "left_semi")


def listing(df: DataFrame, where: Column, order: list[Column], offset: int, size: int) -> DataFrame:
    """A sorted slice of the matching rows with the total count."""
    total = df.filter(where).agg(F.count("*").alias("total")).select("total")
    return df.filter(where).orderBy(*order).offset(offset).limit(size).withColumn("total", total.scalar())


def json_list(col: Column) -> Column:
    """A JSON array of texts without blanks; anything else is empty."""
    parsed = F.from_json(col, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def json_map(col: Column) -> Column:
    """A JSON object as map; bad text is an empty map."""
    return F.coalesce(F.from_json(col, "map<string,string>"), F.create_map().cast("map<string,string>"))


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """Evaluation report: one summary document, all case rows, and the failures."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.filter("not hit_at_k").write.mode("overwrite").json(f"{path}/failures")
