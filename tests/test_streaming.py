"""Streams: duplicates, replacement, keyed state, sources and sinks."""

import tempfile
import time

from pyspark.sql import functions as F

from marginalia.sources import files as SF, tables as ST, topics
from marginalia.streaming import ingest as I, monitor as M, state as S


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_duplicate_messages_do_not_grow(spark):
    src, out, chk = folder(), folder() + "/t", folder()
    schema = "file_md5 string, user_id bigint, ts timestamp_ntz"
    row = lambda m: spark.sql(f"select '{m}' file_md5, 1L user_id, timestamp_ntz'2024-01-01 00:00:00' ts")

    def run():
        live = spark.readStream.schema(schema).parquet(src)
        q = I.once_per_file(live).select("user_id", "file_md5").writeStream.foreachBatch(I.append_new(spark, out, ["user_id", "file_md5"]))
        q.option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()

    row("a").unionByName(row("a")).write.mode("append").parquet(src)
    run()
    row("a").unionByName(row("b")).write.mode("append").parquet(src)
    run()
    assert sorted(r["file_md5"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_ingest_replaces_file_rows(spark):
    src, table, chk = folder(), folder() + "/t", folder()
    schema = "file_md5 string, file_name string, value string"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        I.ingest(spark.readStream.schema(schema).parquet(src), table, chk).awaitTermination()
        return sorted((r["file_md5"], r["chunk_id"], r["text_content"]) for r in I.ingested(spark, table).collect())

    assert run([("a", "a.md", "# Title one"), ("b", "b.txt", "body b")]) == [("a", 0, "Title one"), ("b", 0, "body b")]
    assert run([("a", "a.md", "second text"), ("b", "b.txt", "  ")]) == [("a", 0, "second text")]


def test_file_twice_in_one_batch_counts_once(spark):
    src, table, chk = folder(), folder() + "/t", folder()
    schema = "file_md5 string, file_name string, value string, version int"
    spark.createDataFrame([("a", "a.txt", "old text", 1), ("a", "a.txt", "new text", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    I.ingest(spark.readStream.schema(schema).parquet(src), table, chk, order=["version"]).awaitTermination()
    assert [(r["file_md5"], r["chunk_id"], r["text_content"]) for r in I.ingested(spark, table).collect()] == [("a", 0, "new text")]


def test_state_table_over_three_batches(spark):
    src, out, chk = folder(), folder() + "/t", folder()
    schema = "file_md5 string, chunk_index int"
    for rows in ([("a", 0), ("b", 0), ("a", 0)], [("a", 1), ("a", 2)], [("a", 3), ("a", 1), ("c", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    M.to_table(M.upload_counts(live), out, chk).awaitTermination()
    assert sorted((r["file_md5"], r["received"]) for r in M.newest(spark, out, ["file_md5"]).collect()) == [("a", 4), ("b", 1), ("c", 1)]


def test_validation_and_dead_letters(spark):
    r = spark.createDataFrame([("m", "n", "p", 1), ("m", None, "", 1)], "file_md5 string, file_name string, storage_path string, user_id bigint")
    got = [x["missing"] for x in I.validated(r).collect()]
    assert got == ["", "file_name,storage_path"]
    d = I.dead_letters(r.withColumns({"reason": F.lit("boom"), "attempts": F.lit(3)}))
    assert d.columns == ["file_md5", "user_id", "reason", "attempts", "message"]


def test_rate_limit_stream_equals_batch(spark):
    src, out, chk = folder(), folder() + "/t", folder()
    events = spark.range(60).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 7 % 200 + 1000).cast("double").alias("at"))
    events.coalesce(1).write.mode("append").parquet(src)
    live = S.rate_limited(spark.readStream.schema(events.schema).parquet(src), 3, 20)
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination(120)
    batch = S.rate_limited_batch(events, 3, 20)
    cols = ["user_id", "event_id", "allowed"]
    assert sorted(spark.read.parquet(out).select(cols).collect()) == sorted(batch.select(cols).collect())


def _run_for(query, done, seconds=90):
    end = time.time() + seconds
    try:
        while time.time() < end and not done():
            assert query.exception() is None, query.exception()
            time.sleep(1)
        return done()
    finally:
        query.stop()


def test_chat_history_keeps_the_last(spark):
    src = folder()
    m = spark.range(25).select(F.lit(1).cast("long").alias("conversation_id"), F.col("id").alias("seq"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("content"))
    m.coalesce(1).write.mode("append").parquet(src)
    seen = []
    live = S.chat_history(spark.readStream.schema(m.schema).parquet(src))
    q = live.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append(sorted(r["seq"] for r in df.collect()))).option("checkpointLocation", folder()).start()
    assert _run_for(q, lambda: any(seen))
    assert [s for s in seen if s][0] == list(range(5, 25))


def test_retries_then_failure(spark):
    src = folder()
    spark.createDataFrame([("good",), ("bad",)], "file_md5 string").coalesce(1).write.mode("append").parquet(src)

    def work(file_md5):
        if file_md5 == "bad":
            raise RuntimeError("broken")
        return True

    seen = []
    live = S.with_retries(spark.readStream.schema("file_md5 string").parquet(src), work, 2)
    q = live.writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend((r["file_md5"], r["attempts"], r["status"]) for r in df.collect())).option("checkpointLocation", folder()).trigger(processingTime="1 second").start()
    assert _run_for(q, lambda: ("bad", 2, 4) in seen)
    assert ("good", 1, 3) in seen and ("bad", 1, 2) in seen


def test_status_steps(spark):
    df = spark.createDataFrame([(None, 0, True), (0, 1, True), (1, 3, False), (2, 4, True)], "a int, b int, want boolean")
    assert all(r[0] == r[1] for r in df.select(M.legal_step(F.col("a"), F.col("b")), "want").collect())


def test_text_files_and_registry(spark):
    path = folder()
    for name, text in (("a.md", "# Head\n- item"), ("b.txt", "plain"), ("c.txt", "plain"), ("d.txt", "  ")):
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    b = {r["file_name"]: r["text"] for r in SF.read_text_blocks(spark, path).collect()}
    assert b == {"a.md": "Head\nitem", "b.txt": "plain", "c.txt": "plain"}
    assert sorted(r["copies"] for r in SF.read_registry(spark, path).collect()) == [1, 1, 2]


def test_messages_and_options(spark):
    opts = topics.source_options("h:1", "t", "g")
    assert opts["startingOffsets"] == "latest" and opts["kafka.group.id"] == "g"
    raw = spark.createDataFrame([(b"k", b"{bad", "t", 0, 1), (b"k", b'{"file_md5":"m","user_id":3}', "t", 0, 2)], "key binary, value binary, topic string, partition int, offset long")
    assert [(r["file_md5"], r["user_id"]) for r in topics.decode(raw).orderBy("offset").collect()] == [(None, None), ("m", 3)]
    assert ST.jdbc_options("u", "t", "id", 0, 10, 4)["numPartitions"] == "4"
