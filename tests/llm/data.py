"""Small documents with the cases every operator must handle."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LABELS = "doc_id long, quality int, toxic int"
WORDS = "the of and river stone éclair straße garden 日本 winter amber 42 copper field lantern".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


def rows(seed=5, n=60):
    rnd = random.Random(seed)
    out = [(i, prose(rnd, rnd.randint(1, 80)), "en", f"s{i % 3}", 0) for i in range(n)]
    same = prose(rnd, 60)
    out += [(100 + i, same, "en", "s0", 0) for i in range(25)]  # a third of all rows
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, "no id here", "en", "s1", 0), (None, None, None, None, None),
            (202, " \t\n", "en", "s1", 0), (203, prose(rnd, 6000), "de", "s2", 0), (204, "x" * 30000, "de", "s2", 0), (205, "😀 é\n" * 50, "fr", "s2", 0)]
    out += [(206, "repeated row", "en", "s1", 12)] * 3
    return [(a, t, l, s, None if t is None else len(t)) for a, t, l, s, _ in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def store(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)
