"""Join helpers: size-checked broadcast, salted joins, contains joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALT_ROWS = 100_000
PAIR_ROWS = 20_000_000
MOST_PARTS = 2_000
#: Left rows in a list, about; right rows in a list: a multiple of eight, so that rows that come again have the same bytes when packed.
LIST_ROWS, RUN_ROWS = 64, 256
FEW_TERMS = 64
MANY_TERMS = 100_000


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and arrays by their content, other values eight."""
    out = F.lit(0)
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = F.octet_length(col)
        elif "<" in kind:
            size = F.octet_length(F.to_json(F.struct(col)))
        else:
            size = F.lit(8)
        out = out + F.coalesce(size, F.lit(0)) + 8
    return out


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most `rows` rows and `size` bytes; reads no more than needed to tell."""
    n, total = df.limit(rows + 1).select(_width(df).alias("w")).agg(F.count("*"), F.sum("w")).first()
    return n <= rows and (total or 0) <= size


def salts_for(df: DataFrame, keys: list[str], rows: int = SALT_ROWS) -> int:
    """Into how many parts the most frequent key has to be cut to hold at most about `rows` rows each."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(most or 0) // rows))


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], rows: int = BROADCAST_ROWS, salts: int | None = None
) -> DataFrame:
    """Inner join that broadcasts the small side if it proves small, else spreads hot keys by salt."""
    if is_small(small, rows):
        return big.join(F.broadcast(small), on)
    salts = salts or salts_for(big, on)
    if salts == 1:
        return big.join(small, on)
    # a hash of the row, not a random number: a recomputed task has to place its rows as before
    row = [c for c, kind in big.dtypes if "map<" not in kind]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def _lists(df: DataFrame, on: str, name: str, blocks: Column | int) -> DataFrame:
    """Rows of a key as arrays, dealt into at most `blocks` of them by a hash of the row: (`on`, <name>_no, <name>)."""
    own = [c for c in df.columns if c not in (on, "_blocks")]
    block = F.pmod(F.xxhash64(*own), F.lit(blocks) if isinstance(blocks, int) else blocks)
    return df.groupBy(on, block.alias(f"{name}_no")).agg(F.collect_list(F.struct(*own)).alias(name))


def many_to_many(left: DataFrame, right: DataFrame, on: str, pairs: int = PAIR_ROWS) -> DataFrame:
    """Inner join on a key that many rows of both sides share: small tables, a very large result.

    Lists of left rows meet lists of right rows and are taken apart together: a left row is followed by itself, the same few
    right rows come again with the next one, and a task has few different left rows, so the result is written in about a tenth of
    a byte per row instead of two and more. Tasks are dealt by the rows they make, about `pairs` each, not by the rows they read.
    The right lists are broadcast if they prove small, else repeated per part.
    """
    both = left.groupBy(on).agg(F.count("*").alias("_l")).join(right.groupBy(on).agg(F.count("*").alias("_r")), on)
    each, width = F.col("_l") * F.col("_r"), F.greatest(F.least(F.lit(pairs / 8) / F.col("_r"), F.lit(LIST_ROWS)), F.lit(1))
    n, most, blocks = both.agg(F.sum(each), F.max(each), F.max(F.ceil(F.col("_l") / width))).first()
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = min(MOST_PARTS, -(-(n or 0) // pairs))
    parts = max(parts, cores if (n or 0) > cores * SALT_ROWS else 1)
    lists = _lists(left, on, "_left", int(blocks or 1))
    runs = _lists(right.join(both.select(on, F.ceil(F.col("_r") / (16 * RUN_ROWS)).alias("_blocks")), on), on, "_right", F.col("_blocks"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("_right") - 1) / RUN_ROWS))
    runs = runs.withColumn("_right", F.explode(F.transform(cuts, lambda i: F.slice("_right", (i * RUN_ROWS + 1).cast("int"), F.lit(RUN_ROWS)))))
    if is_small(runs):
        met = lists.repartitionByRange(parts, "_left_no").join(F.broadcast(runs), on)
    else:
        salts = min(MOST_PARTS, max(1, -(-(most or 0) // pairs)))
        dealt = lists.withColumn("_salt", F.pmod("_left_no", F.lit(salts)).cast("int"))
        every = runs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = dealt.repartition(parts, on, "_salt").join(every.repartition(parts, on, "_salt"), [on, "_salt"])
    # sorted, they are taken apart one pair of lists at a time; straight from the join, Spark would hold all rows of a left list
    met = met.sortWithinPartitions("_left_no", on)
    out = met.select(on, F.explode("_left").alias("_l"), "_right").select(on, "_l", F.explode("_right").alias("_r"))
    mine, other = ([c for c in side.columns if c != on] for side in (left, right))
    return out.select(on, *[F.col(f"_l.{c}").alias(c) for c in mine], *[F.col(f"_r.{c}").alias(c) for c in other])


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out again when few tasks would read most of them.

    A file's rows lie in row groups that one task reads whole, however many splits the file has, so rows are counted, not
    partitions; a table as files hold it answers that from the files' footers. Evenly read inputs pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (held[0] or 0) * cores <= 2 * (held[1] or 0):
        return df
    return df.repartition(cores if held[1] < SALT_ROWS else 4 * cores)


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _automaton_matches(texts: DataFrame, text: Column, terms: list[str], keep: list[str]) -> DataFrame:
    """All terms of a bounded list in one pass over each text (Aho-Corasick per Arrow batch)."""
    full = texts.select(*keep, text.alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in full.dtypes if n != "_text") + ", term string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for pdf in frames:
            found = [sorted({t for _, t in automaton.iter(v)}) if v else [] for v in pdf["_text"]]
            yield pdf[keep].assign(term=found).explode("term").dropna(subset=["term"])

    return full.mapInPandas(run, schema)


def contains_matches(texts: DataFrame, text: Column, terms: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of `texts` (their columns `keep`) with every `term` that occurs in their text.

    A few terms travel to each row as one array; more terms, up to a checked bound, as one automaton
    per task. Beyond the bound terms meet the text through an equi join on their first letters
    (three, or all of a shorter term), and only those pairs are verified.
    """
    keep = keep or texts.columns
    terms = terms.select("term").filter(F.length("term") > 0).distinct()
    head = [r[0] for r in terms.limit(MANY_TERMS + 1).collect()]
    if len(head) <= FEW_TERMS:
        known = F.array(*[F.lit(t) for t in sorted(head)]) if head else F.array().cast("array<string>")
        return texts.select(*keep, text.alias("_text")).select(
            *keep, F.explode(F.filter(known, lambda t: F.contains(F.col("_text"), t))).alias("term")
        )
    try:
        import ahocorasick  # noqa: F401

        if len(head) <= MANY_TERMS:
            return _automaton_matches(texts, text, head, keep)
    except ImportError:
        pass
    return gram_matches(texts, text, terms).select(*keep, "term")


def contained_terms(texts: DataFrame, text: Column, terms: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of `texts` (their columns `keep`) with `terms`, the sorted array of all terms in their text; rows without any are left out.

    As `contains_matches`, but a row stays one row: up to the checked bound of terms nothing is shuffled.
    """
    terms = terms.select("term").filter(F.length("term") > 0).distinct()
    head = sorted(r[0] for r in terms.limit(MANY_TERMS + 1).collect())
    if len(head) <= FEW_TERMS:
        known = F.array(*[F.lit(t) for t in head]) if head else F.array().cast("array<string>")
        found = texts.select(*keep, text.alias("_text")).withColumn("terms", F.filter(known, lambda t: F.contains(F.col("_text"), t)))
        return found.filter(F.size("terms") > 0).drop("_text")
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return _collected(gram_matches(texts, text, terms), keep)
    if len(head) > MANY_TERMS:
        return _collected(gram_matches(texts, text, terms), keep)
    full = texts.select(*keep, text.alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in full.dtypes if n != "_text") + ", terms array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in head:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for pdf in frames:
            found = [sorted({t for _, t in automaton.iter(v)}) if v else [] for v in pdf["_text"]]
            out = pdf[keep].assign(terms=found)
            yield out[[len(f) > 0 for f in found]]

    return full.mapInPandas(run, schema)


def _collected(matches: DataFrame, keep: list[str]) -> DataFrame:
    return matches.groupBy(*keep).agg(F.array_sort(F.collect_list("term")).alias("terms"))


def gram_matches(texts: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """`contains_matches` for any number of terms, by an equi join on first letters."""
    keyed = terms.withColumn("_gram", F.left("term", F.lit(3)))
    grams = F.array_distinct(F.concat(*[_grams(F.col("_text"), n) for n in (1, 2, 3)]))
    return (
        texts.withColumn("_text", text).withColumn("_gram", F.explode(grams))
        .join(keyed, "_gram").filter(F.contains("_text", "term")).drop("_text", "_gram")
    )
