"""Windows and greedy packing against step-by-step re-statements of the rules."""

import random

from pyspark.sql import functions as F

from marginalia.operators import blocks as B
from marginalia.operators import chunking as K


def loop_starts(n, size=900, overlap=120):
    out, start = [], 0
    while start < n:
        out.append(start)
        stop = min(start + size, n)
        start = max(stop - overlap, start + 1) if stop - overlap > start else start + size - overlap
    return out


def test_window_starts_for_all_lengths(spark):
    df = spark.range(1, 6000).select(F.col("id").cast("int").alias("n"))
    got = {r["n"]: list(r["s"]) for r in df.select("n", K.window_starts(F.col("n")).alias("s")).collect()}
    for n in range(901, 6000):
        assert got[n] == loop_starts(n), n


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(4000))
    pieces = spark.createDataFrame([(text,)], "t string").select(K.window_pieces(F.col("t")).alias("p")).first()["p"]
    joined = pieces[0] + "".join(p[120:] for p in pieces[1:-1])
    assert joined == text and pieces[-1] == text[-120:]


def greedy(blocks, size):
    """Chunks of one file as lists of block numbers; blocks are (no, text, sheet)."""
    chunks, cur, sheet = [], [], ""
    length = 0
    for no, text, name in blocks:
        if not text:
            continue
        if cur and sheet and name and sheet != name:
            chunks.append(cur)
            cur, sheet, length = [], "", 0
        if len(text) > 2 * size:
            if cur:
                chunks.append(cur)
            chunks.append([no])
            cur, sheet, length = [], "", 0
        elif cur and length + 2 + len(text) > size:
            chunks.append(cur)
            cur, sheet, length = [no], name, len(text)
        else:
            length = length + 2 + len(text) if cur else len(text)
            cur.append(no)
            sheet = sheet or name
    return chunks + ([cur] if cur else [])


def test_packing_is_exact_across_segments(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for md5, n in (("hot", 3000), ("small", 9), ("one", 1)):
        blocks = []
        for i in range(n):
            size = rnd.choice([0, 1, 1, 2, 3, 5, 8, 12, 30, 61])
            blocks.append((i, "x" * size, rnd.choice(["", "", "s1"]) if i < 1500 else rnd.choice(["s1", "s2", ""]) if i % 50 == 0 else "s2"))
        rows += [(md5, i, "text", t, None, None, s, None, "xlsx", "xlsx", None) for i, t, s in blocks]
        want[md5] = greedy(blocks, 30)
    schema = (
        "file_md5 string, block_index int, type string, text string, page int, section string, sheet string, "
        "row_json map<string,string>, source_parser string, file_type string, image_path string"
    )
    b = B.enrich(spark.createDataFrame(rows, schema))
    for segment in (32, 256, 16384):
        got = {}
        for r in K.chunk_starts(b, 30, 4, segment).orderBy("file_md5", "block_index").collect():
            got.setdefault(r["file_md5"], {}).setdefault(r["chunk_start"], []).append(r["block_index"])
        assert {k: list(v.values()) for k, v in got.items()} == want, segment


def test_segments_stay_whole_when_their_entries_are_broadcast(spark):
    """Several files of several segments, written by several tasks: each block goes into one chunk, as packed one by one."""
    rnd = random.Random(11)
    rows, want = [], {}
    for md5 in ("a", "b", "c", "d"):
        blocks = [(i, "x" * rnd.choice([3, 5, 8, 12]), rnd.choice(["s1", "s2", "s3"])) for i in range(900)]
        rows += [(md5, i, t, s, "xlsx") for i, t, s in blocks]
        want[md5] = greedy(blocks, 30)
    b = spark.createDataFrame(rows, "file_md5 string, block_index int, text string, sheet string, file_type string")
    # as with large tables: many read tasks, and the plan joins by shuffle until the entries prove small while it runs
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1024",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = K.chunk_starts(b, 30, 4, 128).orderBy("file_md5", "block_index").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {}
    for r in found:
        got.setdefault(r["file_md5"], {}).setdefault(r["chunk_start"], []).append(r["block_index"])
    assert {k: list(v.values()) for k, v in got.items()} == want


def test_quality_rules(spark):
    schema = (
        "file_md5 string, block_index int, type string, text string, page int, section string, sheet string, "
        "row_json map<string,string>, source_parser string, file_type string, image_path string"
    )
    rows = [
        ("f", 0, "diagram_edge", "a -> b edge", 1, None, None, {"src": "a", "dst": "b"}, "x", "xlsx", "i.png"),
        ("f", 1, "diagram_edge", "a -> a edge", 1, None, None, {"src": "a", "dst": "a"}, "x", "xlsx", "i.png"),
        ("f", 2, "image_ocr", "some long text", None, None, None, None, "x", "docx", None),
        ("f", 3, "table_row", "k: v here", None, None, "s", {"k": "v", "e": ""}, "xlsx", "xlsx", None),
        ("f", 4, "text", "", None, None, None, None, "tika", "txt", None),
    ]
    got = {r["block_index"]: r for r in B.enrich(spark.createDataFrame(rows, schema)).collect()}
    assert got[0]["quality_score"] == 18 + 7 + 16 + 9 + 14 + 28 and got[0]["quality_status"] == "accepted"
    assert got[1]["quality_score"] == 45 and got[1]["validation_flags"] == ["invalid_edge"]
    assert got[2]["quality_score"] == 35 and got[2]["validation_flags"] == ["missing_locator", "missing_image_binding"]
    assert got[3]["quality_score"] == 18 + 7 + 16 + 14 + 8 and got[3]["validation_flags"] == ["sparse_table_row"]
    assert got[4]["quality_score"] == 0 and got[4]["document_unit_key"] == "document:root"
