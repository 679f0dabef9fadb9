"""Topic source and sink (S03, S04). The broker and its connector belong to the deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARSE_REQUEST = (
    "file_md5 string, file_name string, storage_path string, user_id bigint, org_tag string, is_public boolean, "
    "kb_profile string, ts timestamp_ntz"
)


def source_options(servers: str, topic: str, group: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group,
        "startingOffsets": "latest", "failOnDataLoss": "false",
    }


def read_topic(spark: SparkSession, servers: str, topic: str, group: str, schema: str = PARSE_REQUEST) -> DataFrame:
    """JSON values of a topic as columns, with their position for dead letters."""
    raw = spark.readStream.format("kafka").options(**source_options(servers, topic, group)).load()
    return decode(raw, schema)


def decode(raw: DataFrame, schema: str = PARSE_REQUEST) -> DataFrame:
    """Messages (key, value, topic, partition, offset) to columns; bad JSON gives null fields."""
    return raw.select(
        F.from_json(F.col("value").cast("string"), schema).alias("m"), F.col("key").cast("string").alias("key"),
        "topic", "partition", "offset",
    ).select("m.*", "key", "topic", "partition", "offset")


def encode(df: DataFrame, key: str = "file_md5") -> DataFrame:
    """Rows as (key, value) messages; one key keeps its order within its partition."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    encode(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
