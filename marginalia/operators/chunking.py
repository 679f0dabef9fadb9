"""Sliding windows and greedy packing of blocks into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import bind, clean_text
from marginalia.plans.sequence import running_count, with_halo
from marginalia.session import stored


def window_starts(n: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Starts of the windows over a text of n characters, tail window included."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    regular = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    tail = n - overlap
    return F.when(tail > last * step, F.array_append(regular, tail)).otherwise(regular)


def window_pieces(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """The chunk texts of one cleaned text; short texts stay whole, blank pieces vanish."""
    def pieces(t):
        n = F.length(t)
        cut = F.transform(
            window_starts(n, size, overlap), lambda s: clean_text(F.substr(t, s + 1, F.lit(size)))
        )
        return F.filter(F.when(n > size * 2, cut).otherwise(F.array(t)), lambda p: p != "")

    return bind(text, pieces)


# --- greedy packing (C01) -----------------------------------------------------------------------
#
# Packing is sequential: where a chunk starts depends on where the one before ended. It still
# splits: a chunk holds at most MAX_BLOCKS blocks, so the first start inside a segment is one of
# few offsets. Each segment tells, for every such entry offset, at which offset of the next
# segment it leaves; chaining those small tables gives every segment its entry, and then all
# segments are packed independently. Only lengths and sheet names pass through Python.

SEGMENT_BLOCKS = 16384


def _max_blocks(size: int) -> int:
    return size // 3 + 2


def _next_starts(length: np.ndarray, sheet: np.ndarray, xlsx: np.ndarray, group_end: np.ndarray, size: int) -> np.ndarray:
    """For every block, where the next chunk starts if a chunk starts here; never past its group."""
    n = len(length)
    here = np.arange(n)
    ends = np.concatenate([[0], np.cumsum(length + 2)])
    nxt = np.searchsorted(ends, ends[:-1] + size + 2, side="right") - 1
    long_at = length > 2 * size
    longs = np.flatnonzero(long_at)
    after = np.append(longs, n)[np.searchsorted(longs, here, side="right")]
    nxt = np.minimum(np.minimum(np.maximum(nxt, here + 1), after), group_end)
    named = np.flatnonzero((sheet != "") & xlsx)
    if len(named):
        # the sheet of a chunk is that of its first named block; it ends at the next other name
        change = np.flatnonzero(sheet[named][1:] != sheet[named][:-1]) + 1
        run_end = np.append(named[change], n)[np.searchsorted(change, np.arange(len(named)), side="right")]
        first = np.searchsorted(named, here, side="left")
        nxt = np.minimum(nxt, np.append(run_end, n)[first])
    return np.where(long_at, here + 1, np.maximum(nxt, here + 1))


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows sorted by (file, segment, pos) as whole groups with their bounds."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        f, s = pdf["file_md5"].to_numpy(object), pdf["seg"].to_numpy()
        cuts = np.flatnonzero((f[1:] != f[:-1]) | (s[1:] != s[:-1])) + 1
        if len(cuts):
            yield pdf.iloc[: cuts[-1]], np.concatenate([[0], cuts])
            rest = pdf.iloc[cuts[-1]:].reset_index(drop=True)
        else:
            rest = pdf
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _starts_of(pdf: pd.DataFrame, bounds: np.ndarray, size: int) -> np.ndarray:
    group_end = np.repeat(bounds[1:], np.diff(bounds))
    return _next_starts(
        pdf["n_chars"].to_numpy(np.int64), pdf["sheet"].fillna("").to_numpy(object),
        pdf["is_xlsx"].to_numpy(bool), group_end, size,
    )


def _exits(size: int):
    width = _max_blocks(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _grouped(frames):
            nxt, own = _starts_of(pdf, bounds, size), pdf["own"].to_numpy(bool)
            rows = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                stop = lo + int(own[lo:hi].sum())
                out = np.zeros(stop - lo, dtype=np.int64)
                for i in range(stop - 1, lo - 1, -1):
                    out[i - lo] = nxt[i] - stop if nxt[i] >= stop else out[nxt[i] - lo]
                table = np.zeros(width, dtype=np.int64)
                k = min(len(out), width)
                table[:k] = out[:k]
                rows.append((pdf["file_md5"].iat[lo], int(pdf["seg"].iat[lo]), table.tolist()))
            yield pd.DataFrame(rows, columns=["file_md5", "seg", "exits"])

    return run


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seg")
    entry, at = [], 0
    for table in pdf["exits"]:
        entry.append(at)
        at = int(table[at])
    return pd.DataFrame({"file_md5": pdf["file_md5"], "seg": pdf["seg"], "entry": entry})


def _assign(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _grouped(frames):
            nxt, own = _starts_of(pdf, bounds, size), pdf["own"].to_numpy(bool)
            entry = pdf["entry"].to_numpy(np.int64)
            start = np.full(len(pdf), -1, dtype=np.int64)
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                i = lo + entry[lo]
                while i < hi and own[i]:
                    stop = nxt[i]
                    start[i:stop] = i
                    i = stop
            index, mine = pdf["block_index"].to_numpy(), start >= 0
            yield pd.DataFrame(
                {"file_md5": pdf["file_md5"].to_numpy(object)[mine], "block_index": index[mine],
                 "chunk_start": index[start[mine]], "n_pieces": pdf["n_pieces"].to_numpy()[mine]}
            )

    return run


def chunk_starts(
    blocks: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, segment_blocks: int = SEGMENT_BLOCKS
) -> DataFrame:
    """(file_md5, block_index, chunk_start, first_id): the chunk a block goes into.

    `chunk_start` is the first block of the chunk, `first_id` the chunk id of its (first) piece.
    """
    narrow = blocks.select(
        "file_md5", F.col("block_index").cast("long").alias("block_index"), clean_text(F.col("text")).alias("_t"), "sheet",
        (F.lower(F.coalesce("file_type", F.lit(""))) == "xlsx").alias("is_xlsx"),
    ).select(
        "file_md5", "block_index", "sheet", "is_xlsx", F.length("_t").alias("n_chars"),
        F.when(F.length("_t") > 2 * size, F.size(window_pieces(F.col("_t"), size, overlap))).otherwise(1).alias("n_pieces"),
    ).filter("n_chars > 0")
    narrow = running_count(narrow, ["file_md5"], "block_index", F.lit(1), "pos", segment_blocks)
    # small rows, read four times below: written once, so that texts are cleaned and shuffled once
    narrow = stored(with_halo(narrow.withColumn("pos", F.col("pos") - 1), "pos", 0, _max_blocks(size), segment_blocks), "chunk-blocks")

    def placed(df):
        # dealt by a hash of its own: dealt by the columns of a join before it, Spark drops the step, and where it then
        # broadcasts that join's other side it reads the shuffle map by map, which tears segments apart
        return df.repartition(F.xxhash64("file_md5", "seg")).sortWithinPartitions("file_md5", "seg", "pos")

    # the first segment of a file starts a chunk at its first block; only longer files need entries
    longer = narrow.filter("own and seg > 0").select("file_md5").distinct()
    exits = placed(narrow.join(longer, "file_md5", "left_semi")).mapInPandas(
        _exits(size), "file_md5 string, seg long, exits array<int>"
    )
    entries = exits.groupBy("file_md5").applyInPandas(_entries, "file_md5 string, seg long, entry int")
    ready = narrow.join(entries, ["file_md5", "seg"], "left").fillna(0, ["entry"])
    starts = stored(placed(ready).mapInPandas(
        _assign(size), "file_md5 string, block_index long, chunk_start long, n_pieces int"
    ), "chunk-starts")
    heads = starts.filter("block_index = chunk_start").select("file_md5", "chunk_start", "n_pieces")
    ids = running_count(heads, ["file_md5"], "chunk_start", F.col("n_pieces"), "_upto", segment_blocks)
    ids = ids.select("file_md5", "chunk_start", (F.col("_upto") - F.col("n_pieces")).alias("first_id"))
    return starts.drop("n_pieces").join(ids, ["file_md5", "chunk_start"])


def pack_blocks(
    blocks: DataFrame, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP,
    segment_blocks: int = SEGMENT_BLOCKS,
) -> DataFrame:
    """Enriched blocks to chunks with merged metadata and their source list."""
    body = blocks.withColumn("text", clean_text(F.col("text"))).filter(F.col("text") != "")
    placed = body.join(chunk_starts(blocks, size, overlap, segment_blocks), ["file_md5", "block_index"])
    source = F.struct(
        "block_index", F.col("type").alias("source_type"), "source_parser", "sheet", "page", "section",
        "image_path", "document_unit_key", "quality_status", "text", "document_unit_type",
        "document_unit_name", "quality_score", "file_type",
    )
    packed = placed.groupBy("file_md5", "chunk_start", "first_id").agg(F.array_sort(F.collect_list(source)).alias("s"))
    packed = packed.withColumn("_joined", clean_text(F.array_join(F.col("s.text"), "\n\n")))
    long_text = (F.size("s") == 1) & (F.length("_joined") > 2 * size)
    packed = packed.withColumn(
        "pieces", F.when(long_text, window_pieces(F.col("_joined"), size, overlap)).otherwise(F.array("_joined"))
    )

    def first(name):
        """The first non-empty value among the blocks of a chunk."""
        return F.get(F.filter(F.col(f"s.{name}"), lambda v: F.coalesce(v.cast("string"), F.lit("")) != ""), F.lit(0)).alias(name)

    head, status = F.element_at("s", 1), F.col("s.quality_status")
    preview = F.when(F.size("pieces") > 1, F.left("text_content", F.lit(C.PREVIEW_CHARS)))
    sources = F.transform(
        "s",
        lambda b: F.struct(
            b["block_index"], b["source_type"], b["source_parser"], b["sheet"], b["page"], b["section"], b["image_path"],
            F.coalesce(preview, F.left(b["text"], F.lit(C.PREVIEW_CHARS))).alias("text_preview"),
            b["document_unit_key"], b["quality_status"],
        ),
    )
    pieces = packed.select("*", F.posexplode("pieces").alias("_i", "text_content"))
    return pieces.select(
        "file_md5", (F.col("first_id") + F.col("_i")).cast("int").alias("chunk_id"), "text_content",
        F.when(F.size(F.array_distinct("s.source_type")) > 1, "mixed").otherwise(head["source_type"]).alias("chunk_type"),
        first("page"), first("section"), first("sheet"), first("image_path"), head["source_parser"].alias("source_parser"),
        head["file_type"].alias("file_type"), first("document_unit_key"), first("document_unit_type"),
        first("document_unit_name"), F.array_max("s.quality_score").alias("quality_score"),
        F.when(F.array_contains(status, "rejected"), "rejected").when(F.array_contains(status, "weak"), "weak")
        .otherwise(F.element_at(status, -1)).alias("quality_status"),
        sources.alias("sources"),
    )
