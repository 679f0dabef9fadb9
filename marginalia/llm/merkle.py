"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

A paragraph ends with its line break; its digest is the head of its SHA-256. A section ends after a paragraph whose digest
ends in 0 to 3, so sections are cut by content and fall in step again behind an edit; its digest is that of its paragraphs'
digests, and the root is that of the sections' digests. Roots are equal if and only if texts are (up to collisions of 128
bits). Below each paragraph stand its clauses as the leaves, 20-bit hashes in order. A clause ends behind a mark, or behind a
blank that follows an n or s; one that is still longer than LONG, behind blanks that follow further letters, and else by content.

The likeness of two fingerprints is read from their leaves, repeats included (Dice coefficient of the two bags). ``edits`` goes
down the branches that differ: sections, then paragraphs, then clauses are aligned from both ends; between, the n-th copy of a
paragraph in one stands for the n-th in the other, and what has no partner was removed or inserted, what stands in another
order was moved.

A fingerprint is root ":" and for each paragraph the last 8 digits of its digest and 5 digits a clause, ended by "/" where the
section ends and by "." elsewhere: about 0.4 of the text's length in prose.

Only DataFrame functions are used. Defined cases: a null text is an empty one; an empty text has no paragraphs and no leaves; two
texts without leaves have likeness 1; rows are ordered by doc_id descending, nulls last, ties by a hash of the text and the text;
a single row is its own next; an empty table gives no rows; extra columns are kept whatever their names, one that has the name of
a result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import aside, back

#: Code points that end a clause.
MARKS = r".!?,;:\t\n\r\x{2028}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF61}\x{FF64}\x{0964}\x{060C}\x{061B}\x{061F}\x{06D4}"
#: Letters behind which a blank ends a clause, and, in clauses that are still long, further ones.
ENDINGS, MORE = "ns", "etrdao"
#: Characters from which a clause is cut further, and of a piece where its content gives no place to cut.
LONG, WIDTH = 32, 16
#: Bits and digits of a leaf.
BITS, DIGITS = 20, 5
#: Marks a cut; in a text it is a cut, too.
CUT = "\x01"
PARAGRAPH = r"[^\n]*+\n|[^\n]++"
SECTION = r"(?<=[0-3]),"
#: Parts into which documents that share one doc_id, or have none, are dealt.
PARTS = 64
#: Percentile ranges of doc_id, and the rows of a range from which it is cut further.
RANGES, RANGE_ROWS = 2000, 50_000


def _hash(x: Column, bits: int) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit((1 << bits) - 1))


def _cut_long(clause: Column) -> Column:
    """The pieces of a long clause: cut behind characters whose hash with the two before ends in 0000, and where no such place comes
    within LONG, every WIDTH characters."""
    before = lambda chars, i, k: F.coalesce(F.get(chars, i - k), F.lit(""))
    marked = F.array_join(F.flatten(F.transform(F.array(F.split(clause, "")), lambda chars: F.transform(chars, lambda c, i: F.when(
        _hash(F.concat(before(chars, i, 2), before(chars, i, 1), c), 4) == 0, F.concat(c, F.lit(CUT))).otherwise(c)))), "")
    return F.flatten(F.transform(F.filter(F.split(marked, CUT), lambda x: x != ""), lambda x: F.when(
        F.length(x) > LONG, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))).otherwise(F.array(x))))


def _cut_behind(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def clauses(text: Column) -> Column:
    """The leaves: hashes of the clauses in order, each as often as it occurs."""
    leaf = lambda x: _hash(x, BITS).cast("int")
    longer = lambda x, cut: F.when(F.length(x) > LONG, cut(x)).otherwise(F.array(leaf(x)))
    further = lambda x: F.flatten(F.transform(_cut_behind(x, rf"(?<=[{MORE}]\x20)"), lambda y: longer(y, lambda z: F.transform(_cut_long(z), leaf))))
    return F.flatten(F.transform(_cut_behind(text, rf"(?<=[{MARKS}])|(?<=[{ENDINGS}]\x20)"), lambda x: longer(x, further)))


def nodes(text: Column) -> Column:
    """The paragraphs in order: digest and leaves."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.struct(
        F.substring(F.sha2(p, 256), 1, 32).alias("digest"), clauses(p).alias("leaves")))


def leaves(tree: Column) -> Column:
    return F.flatten(F.transform(tree, lambda n: n["leaves"]))


def with_fingerprint(df: DataFrame, tree: str, name: str) -> DataFrame:
    """Add the fingerprint of a column of ``nodes``."""
    sections = F.filter(F.split(F.array_join(F.transform(tree, lambda n: n["digest"]), ","), SECTION), lambda x: x != "")
    root = F.sha2(F.array_join(F.transform(sections, lambda x: F.sha2(x, 256)), ","), 256)
    digits = lambda xs: F.array_join(F.transform(xs, lambda x: F.substring(F.hex(x + (1 << BITS)), 2, DIGITS)), "")
    end = lambda d: F.when(F.substring(d, 32, 1) <= "3", "/").otherwise(".")
    body = F.transform(tree, lambda n: F.concat(F.substring(n["digest"], 25, 8), F.lower(digits(n["leaves"])), end(n["digest"])))
    return df.withColumn(name, F.concat(root, F.lit(":"), F.array_join(body, "")))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two bags of leaves; a leaf counts as often as it occurs in both."""
    total = F.size(a) + F.size(b)
    tagged = lambda xs, tag: F.transform(xs, lambda x: x.cast("long") * 2 + tag)
    # sorted, the copies in a stand before those in b: left are the copies in a that no copy in b has met yet
    start = F.struct(F.lit(-1).cast("long").alias("hash"), F.lit(0).alias("left"), F.lit(0).alias("common"))

    def step(s: Column, x: Column) -> Column:
        hash_, own = F.shiftright(x, 1), x.bitwiseAND(F.lit(1)) == 0
        known = F.when(s["hash"] == hash_, s["left"]).otherwise(0)
        met = ~own & (known > 0)
        return F.struct(hash_.alias("hash"), F.when(own, known + 1).when(met, known - 1).otherwise(known).alias("left"),
                        F.when(met, s["common"] + 1).otherwise(s["common"]).alias("common"))

    # one copy of each leaf by sets; the further copies, few, by a scan
    more = lambda xs: F.flatten(F.transform(F.array(F.sort_array(xs)), lambda s: F.filter(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x))))
    common = F.size(F.array_intersect(a, b)) + F.aggregate(
        F.sort_array(F.concat(tagged(more(a), 0), tagged(more(b), 1))), start, step, lambda s: s["common"])
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def leaves_of(fp: Column) -> Column:
    """The leaves as they stand in a fingerprint."""
    body = F.regexp_replace(F.split_part(fp, F.lit(":"), F.lit(2)), r"(^|[./])[0-9a-f]{8}", "$1")
    return F.transform(F.regexp_extract_all(body, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints."""
    return likeness(leaves_of(a), leaves_of(b))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``fingerprint``."""
    own, names = aside(docs)
    out = with_fingerprint(own.withColumn("_nodes", nodes(F.coalesce(F.col(names[text]), F.lit("")))), "_nodes", "_fingerprint")
    return back(out, {c: n for c, n in names.items() if c != "fingerprint"}, F.col("_fingerprint").alias("fingerprint"))


def _front(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, n).otherwise(at.cast("int") - 1)


def _trimmed(df: DataFrame, a: str, b: str, front: str, key=lambda x: x) -> DataFrame:
    """Cut what two array columns share at their ends; ``front`` is how much they share at the beginning."""
    keys = {c: F.transform(c, key) for c in (a, b)}
    out = df.withColumns({"_ka": keys[a], "_kb": keys[b]}).withColumn(front, _front(F.col("_ka"), F.col("_kb")))
    behind = F.least(_front(F.reverse("_ka"), F.reverse("_kb")), F.least(F.size(a), F.size(b)) - F.col(front))
    out = out.withColumn("_behind", behind)
    return out.withColumns({c: F.slice(c, F.col(front) + 1, F.size(c) - F.col(front) - F.col("_behind")) for c in (a, b)}).drop("_ka", "_kb", "_behind")


def _numbered(xs: Column) -> Column:
    """Keyed elements with the number of each among the copies of its key (0, where no key has copies).

    The first place of a run of copies in the sorted order is carried on by doubling steps.
    """
    keys = F.transform(xs, lambda e: e["key"])
    lone = F.transform(xs, lambda e: F.struct(e["key"].alias("key"), F.lit(0).alias("copy"), e["section"].alias("section"), e["paragraph"].alias("paragraph")))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), lone).otherwise(_copies(xs))


def _copies(xs: Column) -> Column:
    s = F.array_sort(xs)

    def run(s: Column) -> Column:
        first = F.transform(s, lambda e, j: F.when((j > 0) & (F.get(s, j - 1)["key"] == e["key"]), -1).otherwise(j))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(s), F.lit(2)))).cast("int"))
        known = F.aggregate(steps, first, lambda p, k: F.transform(p, lambda v, j: F.greatest(
            v, F.coalesce(F.get(p, (j - F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), k)).cast("int")), F.lit(-1)))))
        return F.zip_with(s, known, lambda e, f: F.struct(e["key"].alias("key"), f.alias("first"), e["section"].alias("section"), e["paragraph"].alias("paragraph")))

    numbered = F.flatten(F.transform(F.array(s), run))
    return F.transform(numbered, lambda e, j: F.struct(e["key"].alias("key"), (j - e["first"]).alias("copy"), e["section"].alias("section"), e["paragraph"].alias("paragraph")))


PLACES = "array<struct<section: int, paragraph: int>>"


def edits(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add what differs between the texts of two fingerprint columns.

    ``same``: roots are equal. ``removed`` and ``moved``: places (section, paragraph) in ``a``; ``inserted``: places in ``b``. A
    changed paragraph was removed in one and inserted in the other. ``clause``: of the clauses in paragraphs that differ, how
    many at the beginning are the same, and how many then were removed and inserted. All are empty where roots are equal.
    """
    own, names = aside(df)
    tree = lambda c: F.split_part(F.col(names[c]), F.lit(":"), F.lit(2))
    out = own.withColumns({"_same": F.split_part(F.col(names[a]), F.lit(":"), F.lit(1)) == F.split_part(F.col(names[b]), F.lit(":"), F.lit(1)),
                           "_a": F.regexp_extract_all(tree(a), F.lit("[^/]*+/|[^/]++"), F.lit(0)), "_b": F.regexp_extract_all(tree(b), F.lit("[^/]*+/|[^/]++"), F.lit(0))})
    out = _trimmed(out, "_a", "_b", "_s")
    paragraphs = lambda c: F.flatten(F.transform(c, lambda s, i: F.transform(F.regexp_extract_all(s, F.lit("[0-9a-f]+"), F.lit(0)), lambda p, j: F.struct(
        p.alias("key"), (F.col("_s") + i).cast("int").alias("section"), j.cast("int").alias("paragraph")))))
    out = _trimmed(out.withColumns({c: paragraphs(c) for c in ("_a", "_b")}), "_a", "_b", "_p", lambda x: x["key"])
    inner = lambda c: F.flatten(F.transform(c, lambda x: F.regexp_extract_all(F.substring(x["key"], 9, 1 << 30), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))))
    # whole paragraphs are trimmed, so clauses in common stand in the first and in the last that differ
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + ((F.length(x["key"]) - 8) / DIGITS).cast("int"))
    out = out.withColumns({"_la": inner(F.slice("_a", 1, 1)), "_lb": inner(F.slice("_b", 1, 1)), "_ra": inner(F.slice("_a", -1, 1)), "_rb": inner(F.slice("_b", -1, 1)),
                           "_ca": size("_a"), "_cb": size("_b")})
    out = out.withColumn("_l", _front(F.col("_la"), F.col("_lb")))
    out = out.withColumn("_r", F.least(_front(F.reverse("_ra"), F.reverse("_rb")), F.col("_ca") - F.col("_l"), F.col("_cb") - F.col("_l")))
    out = out.withColumns({"_na": _numbered(F.col("_a")), "_nb": _numbered(F.col("_b"))})
    side = lambda c, n: F.transform(c, lambda e: F.struct(e["key"].alias("key"), e["copy"].alias("copy"), F.lit(n).alias("side"), e["section"].alias("section"), e["paragraph"].alias("paragraph")))
    out = out.withColumn("_m", F.array_sort(F.concat(side("_na", 0), side("_nb", 1))))
    m = F.col("_m")
    twin = lambda e, other: other.isNotNull() & (other["key"] == e["key"]) & (other["copy"] == e["copy"])
    place = lambda e: F.struct(e["section"].alias("section"), e["paragraph"].alias("paragraph"))
    kinds = F.transform(m, lambda e, j: F.struct(
        e["side"].alias("side"), twin(e, F.get(m, j + 1)).alias("next"), twin(e, F.get(m, j - 1)).alias("before"), place(e).alias("at"), place(F.coalesce(F.get(m, j + 1), e)).alias("there")))
    out = out.withColumn("_k", kinds)
    only = lambda n: F.array_sort(F.transform(F.filter("_k", lambda x: (x["side"] == n) & ~x["next"] & ~x["before"]), lambda x: x["at"]))
    both = F.array_sort(F.transform(F.filter("_k", lambda x: x["next"]), lambda x: F.struct(x["at"].alias("at"), x["there"].alias("there"))))
    out = out.withColumn("_both", both).withColumn("_there", F.array_sort(F.transform("_both", lambda x: F.struct(x["there"].alias("there"), x["at"].alias("at")))))
    moved = F.transform(F.filter(F.zip_with("_both", "_there", lambda x, y: F.struct(x["at"].alias("at"), (x["at"] != y["at"]).alias("off"))), lambda x: x["off"]), lambda x: x["at"])
    clause = F.struct(F.col("_l").cast("int").alias("same"), (F.col("_ca") - F.col("_l") - F.col("_r")).alias("removed"), (F.col("_cb") - F.col("_l") - F.col("_r")).alias("inserted"))
    new = {"same": F.col("_same"), "removed": only(0).cast(PLACES), "inserted": only(1).cast(PLACES), "moved": moved.cast(PLACES), "clause": clause}
    return back(out, {c: n for c, n in names.items() if c not in new}, *[v.alias(k) for k, v in new.items()])


def _rank(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are x at most; looked up among every k-th first, then in one group of k."""
    if not bounds:
        return F.lit(0)
    k = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + k] for i in range(0, len(bounds), k)]
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= x))
    group = F.greatest(upto(F.array(*[F.lit(g[0]) for g in groups])), F.lit(1)) - 1
    return group * k + upto(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group))


def with_next(docs: DataFrame, columns: list[str], make: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by doc_id descending; the last is followed by the first.

    ``make`` may add columns that follow from a row's text (it gets the rows and the text's name there); they are computed once a row
    and can be among ``columns``. Rows are dealt to ranges of doc_id by percentiles, and large tables within those by equal widths; a range's last row
    finds its follower in a copy of the next range's first row. Ids that fill whole ranges, and missing ids, are cut further
    by a hash of the text. Only bounds and one key per range, 24 bytes for about RANGE_ROWS rows, reach the driver.
    """
    spark = docs.sparkSession
    docs, names = aside(docs)
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    ranges = min(RANGES, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found, low, high, n = docs.agg(F.percentile_approx(doc_id, [i / ranges for i in range(1, ranges)], 10 * ranges),
                                   F.min(doc_id), F.max(doc_id), F.count(doc_id)).first()
    found = found or []
    bounds, widths = sorted(set(found)), -(-n // (ranges * RANGE_ROWS)) or 1
    hot = sorted({x for x in found if found.count(x) > 1})
    at = _rank(doc_id, bounds)
    cut_further = doc_id.isNull() | (doc_id.isin(hot) if hot else F.lit(False))
    # descending: the number of the range from above, then of the width inside it
    span = F.when(doc_id.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - at).cast("long") * widths
    if widths > 1:
        least, most = (F.element_at(F.array(*map(F.lit, xs)).cast("array<double>"), at + 1) for xs in ([low, *bounds], [*bounds, high]))
        share = F.floor((doc_id.cast("double") - least) / F.greatest(most - least, F.lit(1.0)) * widths)
        span = span + F.coalesce(widths - 1 - F.greatest(F.least(share, F.lit(widths - 1)), F.lit(0)), F.lit(0))
    # an id that is cut further stands in a range of its own behind the rest of its range: bounds are the least ids of ranges
    keyed = docs.withColumn("_h", F.xxhash64(text)).withColumn(
        "_o", span * (PARTS + 1) + F.when(cut_further, F.shiftrightunsigned("_h", 58).cast("int") + 1).otherwise(0)) \
        .withColumn("_d", F.bitwise_not(doc_id)).withColumn("_h", F.shiftrightunsigned("_h", 1))
    order = lambda name: F.struct(F.col("_d").isNull().alias("none"), F.col("_d").alias("d"), F.col("_h").alias("h")).alias(name)
    heads = sorted((r["_o"], r["head"]["d"], r["head"]["h"]) for r in keyed.select("_o", order("s")).groupBy("_o").agg(F.min("s").alias("head")).collect())
    follow = [(heads[(i + 1) % len(heads)][1], heads[(i + 1) % len(heads)][2], o) for i, (o, _, _) in enumerate(heads)]
    key = spark.createDataFrame(follow, "_kd long, _kh long, _ko long")
    copies = keyed.join(F.broadcast(key), F.col("_d").eqNullSafe(F.col("_kd")) & (F.col("_h") == F.col("_kh"))) \
        .withColumn("_o", F.col("_ko")).drop("_kd", "_kh", "_ko").dropDuplicates(["_o"]).withColumn("_copy", F.lit(1))
    rows = keyed.withColumn("_copy", F.lit(0)).unionByName(copies)
    before = set(rows.columns)
    rows = make(rows, names["text"]) if make else rows
    made = [c for c in rows.columns if c not in before]
    line = W.partitionBy("_o").orderBy("_copy", F.col("_d").asc_nulls_last(), "_h", text)
    found = rows.select("*", *(F.lead(names.get(c, c)).over(line).alias(f"_next_{c}") for c in columns)).where("_copy = 0")
    return back(found, names, *made, *(F.col(f"_next_{c}").alias(f"next_{c}") for c in columns))


def op2(spark, sf_dir):
    """Own and edited text share the lines before the edit: their nodes are made once, and a row's leaves go on to the row before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def trees(rows: DataFrame, text: str) -> DataFrame:
        n = F.length(text)
        rows = rows.withColumn("kept", (n - F.floor(n / 3)).cast("int"))
        rows = rows.withColumn("lines", F.length(F.regexp_extract(F.substring(F.col(text), F.lit(1), F.col("kept")), r"(?s)\A.*\n", 0)))
        rows = rows.withColumn("shared", nodes(F.substring(F.col(text), F.lit(1), F.col("lines"))))
        return rows.withColumn("own", F.concat("shared", nodes(F.substring(text, F.col("lines") + 1, n)))).withColumn("leaves", leaves(F.col("own")))

    n = F.length("text")
    both = with_next(docs, ["text", "leaves"], trees)
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("kept")), F.substring(F.col("next_text"), F.lit(1), n - F.col("kept"))))
    both = both.withColumn("edited_nodes", F.concat("shared", nodes(F.substring("edited", F.col("lines") + 1, F.length("edited")))))
    out = with_fingerprint(with_fingerprint(both, "own", "fingerprint"), "edited_nodes", "edited_fingerprint").select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), leaves(F.col("edited_nodes"))).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))
    return edits(out, "fingerprint", "edited_fingerprint")
