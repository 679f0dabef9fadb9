"""Ordered operators that stay parallel when one key owns most of the rows.

A plain window over (key) puts a whole key into one task. These helpers cut every key
into segments of its integer position, work inside segments, and carry only one small
row per segment across. They need an integer position column per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = 16384


def segment(pos: Column, size: int = SEGMENT) -> Column:
    return F.floor(pos / size).cast("long")


def with_halo(
    df: DataFrame, pos: str, before: int, after: int, size: int = SEGMENT
) -> DataFrame:
    """Copy the rows near a segment border into the neighbour segment.

    Adds `seg` and `own`; a window by (key, seg) over a range of `before`/`after` positions
    then sees all it needs, and `own` rows are the ones to keep. Positions start at 0.
    """
    assert before < size and after < size
    p = F.col(pos)
    home = segment(p, size)
    offset = F.pmod(p, F.lit(size))
    prev = F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long")
    nxt = F.when(offset >= size - before, home + 1) if before else F.lit(None).cast("long")
    targets = F.array_compact(F.array(home, prev, nxt))
    return df.withColumn("seg", F.explode(targets)).withColumn("own", F.col("seg") == home)


def _carry_in(df: DataFrame, keys: list[str], per_segment: Column, combine) -> DataFrame:
    """One value per (key, segment), folded over all earlier segments of the key."""
    w = W.partitionBy(*keys).orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return (
        df.groupBy(*keys, "seg")
        .agg(per_segment.alias("_v"))
        .select(*keys, "seg", combine(F.col("_v")).over(w).alias("_carry"))
    )


def carry_forward(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, size: int = SEGMENT,
    strict: bool = False,
) -> DataFrame:
    """Last non-null value at or before each row (forward fill); strictly before with `strict`."""
    df = df.withColumn("_val", value).withColumn("seg", segment(F.col(pos), size))
    last = F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(pos)))
    carry = _carry_in(df, keys, last, lambda v: F.last(v, ignorenulls=True))
    end = -1 if strict else 0
    w = W.partitionBy(*keys, "seg").orderBy(pos).rowsBetween(W.unboundedPreceding, end)
    return (
        df.withColumn("_here", F.last("_val", ignorenulls=True).over(w))
        .join(carry, [*keys, "seg"], "left")
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_val", "_here", "_carry", "seg")
    )


def running_count(
    df: DataFrame, keys: list[str], pos: str, flag: Column, out: str, size: int = SEGMENT
) -> DataFrame:
    """How many flagged rows there are at or before each row of the key."""
    df = df.withColumn("_one", flag.cast("long")).withColumn("seg", segment(F.col(pos), size))
    carry = _carry_in(df, keys, F.sum("_one"), F.sum)
    w = W.partitionBy(*keys, "seg").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.withColumn("_here", F.sum("_one").over(w))
        .join(carry, [*keys, "seg"], "left")
        .withColumn(out, F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_one", "_here", "_carry", "seg")
    )


def ordered_concat(
    df: DataFrame, keys: list[str], pos: str, text: Column, sep: str, out: str, size: int = SEGMENT
) -> DataFrame:
    """Concatenate texts of a key in position order, first inside segments, then across them."""
    parts = (
        df.withColumn("seg", segment(F.col(pos), size))
        .groupBy(*keys, "seg")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), text.alias("t")))).alias("_a"))
        .select(*keys, "seg", F.array_join(F.col("_a.t"), sep).alias("_t"))
    )
    return (
        parts.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("seg", "_t"))).alias("_a"))
        .select(*keys, F.array_join(F.col("_a._t"), sep).alias(out))
    )


def top_rows(
    df: DataFrame, keys: list[str], order: list[Column], k: int | Column, out: str = "rank", at_most: int | None = None
) -> DataFrame:
    """The first k rows per key with their rank; Spark cuts per map task before the shuffle.

    That early cut needs a number: where k is a column, `at_most` is the largest k there can be.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(w))
    if at_most is not None:
        ranked = ranked.filter(F.col(out) <= at_most)
    return ranked.filter(F.col(out) <= k)
