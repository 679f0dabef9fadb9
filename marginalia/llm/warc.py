"""WARC archives: a writer and a splittable reader.

The writer makes one record per page, each its own gzip member. Of records with equal payloads of at least ``least``
bytes, the one with the smallest page_id is a ``response``; the others are ``revisit`` records that name it and repeat
its digest. Every task writes files of its own name into the shared folder, and a stored list names the files of the
attempts that succeeded, so a repeated task never leaves a half-written file among those that are read.

The reader cuts files into byte ranges. A range looks for the gzip magic, takes a candidate as a member only if its
first bytes inflate to a WARC header, and owns the records that start inside it, read to their end wherever that is.
Members inside a range follow one another, so candidates are searched only up to the first. A magic inside a compressed
payload does not inflate to a header, and bytes before the first member belong to the range before.

Files are reached through pyarrow's file systems (local and mounted folders, HDFS, object stores), by URI.

Defined cases: a null or empty html is an empty payload; a null page_id is written as an empty id and reads as null, and
never is the record others refer to unless all with that payload are null (then each is a response); repeated page_ids
give one record per row; an empty table gives no files; extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import scratch, ship, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
RANGE_BYTES = 16 << 20
FILE_BYTES = 256 << 20
READ = 1 << 20
RECORDS = ("file string, offset long, page_id string, url string, record_type string, refers_to string, payload_digest string, "
           "payload_bytes long, payload binary")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """A Spark path as a URI that pyarrow takes."""
    if path.startswith("file:"):
        return "file://" + "/" + path[5:].lstrip("/")
    return path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path}"


def record(page_id: str | None, url: str | None, kind: str, refers_to: str | None, payload: bytes, digest: str) -> bytes:
    """One record as a gzip member. A revisit has no payload; its length stands in a header."""
    name = "" if page_id is None else quote(page_id, safe="")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Target-URI", quote(url or "", safe="/:?&=#%+,;@~!$()*'[]")),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>")]
    body = b"" if kind == "revisit" else payload
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def planned(pages: DataFrame, least: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, payload and, for revisits, refers_to."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")) \
        .where("_n > 1 AND refers_to IS NOT NULL").drop("_n")
    met = rows.withColumn("_key", F.when(large, F.col("digest"))).join(first.withColumnRenamed("digest", "_key"), "_key", "left")
    own = F.col("page_id").eqNullSafe(F.col("refers_to"))
    return met.select("page_id", "url", "payload", F.when(~own, F.col("refers_to")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES, **names) -> DataFrame:
    """Write archives into ``folder`` and return the list of files written: file, bytes, records."""
    ship(pages.sparkSession)
    base = _uri(folder)
    rows = planned(pages, least, **names).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def archive(batches):
        store, root = _open(base)
        store.create_dir(root, recursive=True)
        out, done, size, count, name = None, [], 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                payload = row["payload"]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = "response" if row["refers_to"] is None else "revisit"
                data = record(row["page_id"], row["url"], kind, row["refers_to"], payload, digest)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{base}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{base}/{name}", size, count))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["file", "bytes", "records"])

    return stored(rows.mapInArrow(archive, "file string, bytes long, records long"), "archives")


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _starts_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(VERSION)
    except zlib.error:
        return False


def _first(source, start: int, end: int, size: int) -> int | None:
    """The first member that starts in [start, end): candidates by magic, proven by the header they inflate to."""
    at = start
    while at < end:
        source.seek(at)
        data = source.read(min(READ, end - at) + 1024)
        p = data.find(MAGIC)
        while 0 <= p and at + p < end and p < READ:
            if len(data) - p < 1024 and at + len(data) < size:
                break  # read on from here
            if _starts_record(data[p:p + 1024]):
                return at + p
            p = data.find(MAGIC, p + 1)
        at = at + p if 0 < p < READ else at + READ
    return None


def members(source, start: int, end: int, size: int):
    """(offset, record) of the members that start in [start, end)."""
    at = _first(source, start, end, size)
    while at is not None and at < end:
        source.seek(at)
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            data = source.read(READ)
            if not data:
                raise ValueError(f"the record at {at} is cut short")
            parts.append(unpack.decompress(data))
            used += len(data)
        used -= len(unpack.unused_data)
        yield at, b"".join(parts)
        at += used
        if at < size:
            source.seek(at)
            if not _starts_record(source.read(1024)):
                at = _first(source, at, end, size)  # foreign bytes between members
        else:
            at = None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header(head)
    return fields, rest[:int(fields.get("content-length", 0))]


def _page(urn: str | None) -> str | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return unquote(name) if name else None


def read(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the listed files (file, bytes): RECORDS. The payload of a revisit is null."""
    ship(spark)
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    # a range is a task's work though its row is tiny, so their number is fixed and not left to the size of the shuffle
    n = files.select(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), 10_000))

    def run(batches):
        for batch in batches:
            for task in batch.to_pylist():
                store, path = _open(task["file"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for at, raw in members(source, task["start"], min(task["start"] + range_bytes, task["bytes"]), task["bytes"]):
                        f, payload = parse(raw)
                        kind = f.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        rows.append((task["file"], at, _page(f.get("warc-record-id")), unquote(f.get("warc-target-uri", "")), kind,
                                     _page(f.get("warc-refers-to")), (f.get("warc-payload-digest") or "").removeprefix("sha1:"),
                                     int(f.get("warc-payload-length", len(payload))), None if kind == "revisit" else payload))
                        held += len(payload)
                        if held > 16 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, RECORDS)


def _batch(rows):
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=[c.split()[0] for c in RECORDS.split(", ")])


def op3(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = write(pages, scratch(spark, "warc"))
    records = read(spark, files)
    kind = pages.schema["page_id"].dataType
    full = F.octet_length("payload").cast("long")
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), F.coalesce(full, F.col("payload_bytes")).alias("payload_bytes"), "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")


#: DuckDB has sha1 but no base32: hexadecimal digits go to five-bit letters by way of bits.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, octet_length(body) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_aggregate(list_transform(range(0, 5), lambda j:
           ((strpos('0123456789abcdef', substr(hex, 1 + CAST((5 * i + j) // 4 AS INT), 1)) - 1) >> (3 - ((5 * i + j) % 4))::INT) % 2 * (16 >> j::INT)), 'sum') AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM d
"""
