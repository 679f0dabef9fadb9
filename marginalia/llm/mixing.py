"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A mix of a given total is shared by weight; a source's target stops at a maximum number of epochs (times its size), and what
it cannot take is shared again among the others by weight until none is above its stop. A source of size S and target t
takes every document ``t div S`` times. The rest, ``t mod S`` words, comes from a seeded order of its documents: those before
the cut once more, the document at the cut in part, so that a source's words differ from its target by rounding alone.

The order is never laid out. Its key is a hash, so the words before a place are found from sums over ranges of the key: each
pass sums the range that holds the cut in ``FAN`` parts and goes on in one of them, for all sources at once, until the range
holds few rows. Documents are neither sorted nor shuffled; sums are combined before the shuffle; only the last range of each
source, at most ``LAST`` rows of one source, is ordered. Rows with equal keys (the same id and text) have equal sizes, so it
does not matter which of them come first; their row numbers decide.

Only DataFrame functions are used, and per pass the driver sees one row of sums.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null doc_id counts as an empty
one in the order; repeated rows are rows of their own; sources without words have target 0; if every source stops below its
share, all targets are at their stops; an empty table gives no rows; extra columns are kept by ``mixture`` whatever their
names, and left out by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.plans.joins import lookup_join
from marginalia.session import stored

SEED = 23
EPOCHS, SHARE = 2, 1.5
#: Parts into which a pass cuts each range (a power of two), its bits, and the rows of a source that are ordered at last.
FAN_BITS = 10
LAST = 4_000
KEY_BITS, ROW_BITS = 60, 60
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """The first 60 bits of the MD5 of seed, id and text."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), blank(doc_id), blank(text))), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED, text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, _source, size, _key, _row) of every document, written once. ``_row`` tells rows with equal keys apart."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    slim = stored(docs.select(
        F.col("doc_id"), F.concat(F.lit("s"), F.col(source)).alias("_name"), words_in(F.col(text)).alias("size"),
        seeded_key(F.col("doc_id"), F.col(text), seed).alias("_key"), number.alias("_number")), "mixing")
    return slim.select("doc_id", F.coalesce("_name", F.lit("")).alias("_source"), "size", "_key",
                       F.shiftrightunsigned(F.xxhash64("_number"), 64 - ROW_BITS).alias("_row"), "_number")


def cycled(sources: DataFrame, weights: list[float]) -> DataFrame:
    """``sources`` and ``weight``: the given weights in turn, by code point of the source, the null source last.

    Sources are dealt to ranges of their names and numbered inside them; one row per range tells where its numbers begin.
    """
    ranges = stored(sources.repartitionByRange(F.col("_source") == "", "_source")
                    .sortWithinPartitions(F.col("_source") == "", "_source").withColumn("_at", F.monotonically_increasing_id()), "sources")
    ranges = ranges.withColumn("_part", F.shiftright("_at", 33))
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranges.join(F.broadcast(starts), "_part").withColumn("weight", F.get(turn, (number % len(weights)).cast("int"))) \
        .drop("_part", "_before", "_at")


def water_filled(sources: DataFrame, total: float, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (_source, source_size, weight) and ``target``.

    Each round shares what the stopped sources leave among the others and stops those that it lifts above their caps; the
    level only rises, so no source is ever freed again. One row of sums a round reaches the driver.
    """
    cap, weight = F.col("source_size") * F.lit(float(epochs)), F.col("weight")
    left, shared = F.lit(0.0), F.lit(1.0)
    held = -1
    while True:
        stopped = (weight > 0) & (cap * shared <= left * weight)
        free = (weight > 0) & ~stopped
        n, caps, sum_ = sources.agg(F.count(F.when(stopped, 1)), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0.0)),
                                    F.coalesce(F.sum(F.when(free, weight)), F.lit(0.0))).first()
        if n == held or not sum_:
            break
        held, left, shared = n, F.lit(max(0.0, total - caps)), F.lit(sum_)
    return sources.withColumn("target", F.when(stopped, cap).when(free, F.least(cap, left * weight / shared)).otherwise(0.0))


def _narrowed(rows: DataFrame, cuts: DataFrame, key: str, bits: int, last: int) -> DataFrame:
    """Go on, in ``FAN`` parts a pass, until each range (``_prefix``: the key without its last ``_bits`` bits) that holds a
    cut has at most ``last`` rows or one key. ``_before`` counts the words of the range's source before it."""
    done = None
    cuts = cuts.withColumn("_bits", F.lit(bits)).withColumn("_prefix", F.lit(0).cast("long"))
    while bits:
        open_ = stored(cuts.where(F.col("_rows") > last), "cuts")
        settled = cuts.where(F.col("_rows") <= last)
        done = settled if done is None else done.unionByName(settled)
        if open_.isEmpty():
            return done
        step = min(FAN_BITS, bits)
        inside = lookup_join(rows, open_, ["_source"]).where(F.shiftright(key, bits) == F.col("_prefix"))
        parts = inside.groupBy("_source", F.shiftright(key, bits - step).alias("_part")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        upto = F.sum("_sum").over(W.partitionBy("_source").orderBy("_part"))
        found = parts.withColumn("_upto", upto).join(open_.select("_source", "_want", "_before"), "_source") \
            .where((F.col("_before") + F.col("_upto") >= F.col("_want")) & (F.col("_before") + F.col("_upto") - F.col("_sum") < F.col("_want")))
        bits -= step
        cuts = stored(found.select("_source", "_want", (F.col("_before") + F.col("_upto") - F.col("_sum")).alias("_before"), F.col("_n").alias("_rows"),
                                   F.lit(bits).alias("_bits"), F.col("_part").alias("_prefix")), "cuts")
    return cuts if done is None else done.unionByName(cuts)


def mix(docs: DataFrame, weights: list[float] | DataFrame, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED,
        text: str = "text", source: str = "source", row: str | None = None, last: int = LAST) -> DataFrame:
    """doc_id, the source, size, source_size, target, repeats (whole) and extra (words of the fractional one) of every row.

    ``weights``: numbers given in turn, or a table (source, weight). ``share`` of all words is mixed. ``row`` names a column
    that numbers the rows; it is kept.
    """
    rows = sized(docs, seed, text, source, row)
    sizes = stored(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "sizes")
    if isinstance(weights, DataFrame):
        known = weights.groupBy(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = sizes.join(known, "_source", "left").fillna(0.0, ["weight"])
    else:
        weighted = cycled(sizes, weights)
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    filled = water_filled(stored(weighted, "weights"), total, epochs)
    aim = F.floor(F.col("target") + 0.5).cast("long")
    plan = stored(filled.withColumn("_repeats", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div greatest(source_size, 1)")).otherwise(0).cast("long"))
                  .withColumn("_want", aim - F.col("_repeats") * F.col("source_size")), "targets")
    cuts = plan.where("_want > 0").select("_source", "_want", F.lit(0).cast("long").alias("_before"), "_rows")
    ends = stored(_narrowed(rows, cuts, "_key", KEY_BITS, last), "ends")
    # equal keys are equal rows: their row numbers are cut the same way
    same = ends.where((F.col("_bits") == 0) & (F.col("_rows") > last))
    by_row = None
    if not same.isEmpty():
        tied = lookup_join(rows, same.select("_source", F.col("_prefix").alias("_tied")), ["_source"]).where("_key = _tied").drop("_tied")
        by_row = stored(_narrowed(tied, same.select("_source", "_want", "_before", "_rows"), "_row", ROW_BITS, last)
                        .select("_source", F.col("_prefix").alias("_row_prefix"), F.col("_bits").alias("_row_bits"), F.col("_before").alias("_row_before")), "ends")
    at = plan.select("_source", "source_size", "target", "_repeats", "_want").join(ends.select("_source", "_before", "_bits", "_prefix"), "_source", "left")
    none = F.lit(None).cast("long")
    at = at.join(by_row, "_source", "left") if by_row is not None else at.select("*", none.alias("_row_prefix"), F.lit(None).cast("int").alias("_row_bits"), none.alias("_row_before"))
    placed = lookup_join(rows, stored(at, "plan"), ["_source"]) \
        .withColumn("_range", F.expr("shiftright(_key, _bits)")).withColumn("_row_range", F.expr("shiftright(_row, _row_bits)"))
    # -1 before, 0 inside, 1 behind the range of the cut
    sign = lambda a, b: F.signum((F.col(a) - F.col(b)).cast("double"))
    side = F.when(F.col("_prefix").isNull(), F.lit(1.0)).when(F.col("_range") != F.col("_prefix"), sign("_range", "_prefix")) \
        .when(F.col("_row_prefix").isNull(), F.lit(0.0)).otherwise(sign("_row_range", "_row_prefix"))
    placed = placed.withColumn("_side", side)
    kept = ["doc_id", F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias(source), "size", "source_size", "target",
            F.col("_repeats").alias("repeats")] + ([F.col("_number").alias(row)] if row else [])
    outside = placed.where("_side <> 0").select(*kept, F.when(F.col("_side") < 0, F.col("size")).otherwise(0).cast("long").alias("extra"))
    before = F.sum("size").over(W.partitionBy("_source").orderBy("_key", "_row").rowsBetween(W.unboundedPreceding, -1))
    start = F.coalesce("_row_before", "_before") + F.coalesce(before, F.lit(0))
    inside = placed.where("_side = 0").withColumn("_start", start)
    return outside.unionByName(inside.select(*kept, F.greatest(F.lit(0), F.least("size", F.col("_want") - F.col("_start"))).cast("long").alias("extra")))


def mixture(docs: DataFrame, weights: list[float] | DataFrame, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED,
            text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``: each as often as it is taken, the last time with its first
    ``extra`` words only where it is taken in part."""
    whole = stored(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_id")), "documents")
    flat = whole.select(F.col("_doc.doc_id").alias("doc_id"), F.col(f"_doc.`{text}`").alias("text"), F.col(f"_doc.`{source}`").alias("source"), "_id")
    plan = mix(flat, weights, share, epochs, seed, row="_id").select("_id", "size", "repeats", "extra")
    times = F.col("repeats") + (F.col("extra") > 0).cast("long")
    copies = whole.join(plan, "_id").where((F.col("repeats") > 0) | (F.col("extra") > 0)) \
        .withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("_time") > F.col("repeats")) & (F.col("extra") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_doc.`{text}`"), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("extra"), F.lit(1)).cast("int")), " ")
    cut = F.when(part, head).otherwise(F.col(f"_doc.`{text}`"))
    return copies.select(*[(cut if c == text else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


WEIGHTS = [3.0, 1.0, 2.0]


def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, WEIGHTS).select(
        "doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken"), "source", "repeats")


#: The same mix by laying all rows in order.
SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint AS k FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size,
  [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::double AS w FROM d GROUP BY source),
t AS (SELECT *, {SHARE}::double * sum(source_size) OVER () AS total, sum(w) OVER () AS ws, {EPOCHS}.0::double * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER p, 0) AS cs, coalesce(sum(w) OVER p, 0) AS wb FROM t
  WINDOW p AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (ws - wb) <= (total - cs) * w AS stopped FROM r),
l AS (SELECT coalesce(sum(cap) FILTER (stopped), 0) AS held, coalesce(sum(w) FILTER (NOT stopped), 0) AS free FROM c),
g AS (SELECT source, source_size, CASE WHEN stopped THEN cap ELSE least(cap, (total - held) * w / free) END AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::bigint // greatest(source_size, 1) ELSE 0 END AS repeats FROM g),
o AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.repeats, floor(p.target + 0.5)::bigint - p.repeats * p.source_size AS want,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (repeats * size + greatest(0, least(size, want - start)))::bigint AS taken, source, repeats::bigint AS repeats FROM o
"""
