"""Segmented sequence helpers against plain windows, with one key owning most rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.plans import joins, sequence as S


def rows(spark):
    hot = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("pos"))
    cold = spark.range(7).select(F.lit("cold").alias("k"), F.col("id").alias("pos"))
    df = hot.unionByName(cold)
    return df.withColumn("v", F.when(F.xxhash64("k", "pos") % 5 == 0, F.col("pos") * 10)).withColumn("f", F.xxhash64("pos") % 3 == 0)


def test_carry_forward(spark):
    df = rows(spark)
    for strict in (False, True):
        w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1 if strict else 0)
        want = df.withColumn("o", F.last("v", ignorenulls=True).over(w)).select("k", "pos", "o")
        got = S.carry_forward(df, ["k"], "pos", F.col("v"), "o", 16, strict).select("k", "pos", "o")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_count(spark):
    df = rows(spark)
    w = W.partitionBy("k").orderBy("pos")
    want = df.withColumn("o", F.sum(F.col("f").cast("long")).over(w)).select("k", "pos", "o")
    got = S.running_count(df, ["k"], "pos", F.col("f"), "o", 16).select("k", "pos", "o")
    assert sorted(got.collect()) == sorted(want.collect())


def test_halo_window(spark):
    df = rows(spark)
    frame = W.partitionBy("k").orderBy("pos").rangeBetween(-3, 2)
    want = df.withColumn("o", F.count("v").over(frame)).select("k", "pos", "o")
    near = S.with_halo(df, "pos", 3, 2, 8)
    seg = W.partitionBy("k", "seg").orderBy("pos").rangeBetween(-3, 2)
    got = near.withColumn("o", F.count("v").over(seg)).filter("own").select("k", "pos", "o")
    assert sorted(got.collect()) == sorted(want.collect())


def test_ordered_concat(spark):
    df = rows(spark)
    got = {r["k"]: r["t"] for r in S.ordered_concat(df, ["k"], "pos", F.col("pos").cast("string"), ",", "t", 16).collect()}
    assert got["hot"] == ",".join(map(str, range(500))) and got["cold"] == "0,1,2,3,4,5,6"


def test_contains_matches_all_ways(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, ""), (4, "ab")], "id int, t string")
    words = ["a", "ab", "cde", "yz", "zz", "abcdefg", "f"] + [f"q{i}" for i in range(100)]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    want = sorted((i, w) for i, t in ((1, "abcdef"), (2, "xyz"), (4, "ab")) for w in words if w in t)
    for df in (
        joins.contains_matches(texts, F.col("t"), terms), joins.contains_matches(texts, F.col("t"), terms.limit(7)),
        joins.gram_matches(texts, F.col("t"), terms),
    ):
        assert sorted((r["id"], r["term"]) for r in df.collect()) == want


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, n string")
    a = joins.lookup_join(big, small, ["k"]).select("k", "v", "n")
    b = joins.lookup_join(big, small, ["k"], rows=1, salts=4).select("k", "v", "n")
    assert sorted(a.collect()) == sorted(b.collect())
