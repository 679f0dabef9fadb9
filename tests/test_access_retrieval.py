"""Access never leaks; channels and fusion on small rows."""

import numpy as np
from pyspark.sql import functions as F

from marginalia.operators import acl, graph as G, retrieval as R, vectors as V


def docs(spark):
    rows = [
        ("f1", 0, "vector search basics", 1, "DEFAULT", True), ("f2", 0, "keyword search basics", 1, "DEFAULT", True),
        ("f3", 0, "hybrid search", 1, "DEFAULT", True), ("f4", 0, "secret private plan of nine", 999, "PRIVATE_TAG", False),
        ("f5", 0, "public plan of other team", 999, "OTHER_TAG", True), ("f6", 0, "team plan", 999, "LEAF", False),
    ]
    df = spark.createDataFrame(rows, "file_md5 string, chunk_id int, text_content string, user_id bigint, org_tag string, is_public boolean")
    tags = spark.createDataFrame([("ROOT", None), ("MID", "ROOT"), ("LEAF", "MID"), ("A", "B"), ("B", "A")], "tag_id string, parent_tag string")
    return acl.with_file_tokens(df.withColumn("file_name", F.col("file_md5")), acl.tag_ancestors(tags)), tags


def users(spark):
    u = spark.createDataFrame([(1, "USER", ""), (2, "USER", " ROOT ,"), (3, "ADMIN", ""), (999, "USER", "")], "user_id bigint, role string, org_tags string")
    return u.select("user_id", acl.user_tokens(F.col("role"), F.col("user_id"), F.col("org_tags")).alias("tokens"))


def test_readable_files(spark):
    files, _ = docs(spark)
    got = {}
    for r in acl.readable_files(users(spark), files, 3).collect():
        got.setdefault(r["user_id"], []).append(r["file_md5"])
    assert {k: sorted(v) for k, v in got.items()} == {
        1: ["f1", "f2", "f3", "f5"], 2: ["f1", "f2", "f3", "f5", "f6"],
        3: ["f1", "f2", "f3", "f4", "f5", "f6"], 999: ["f1", "f2", "f3", "f4", "f5", "f6"],
    }


def test_tag_tree_with_cycle(spark):
    _, tags = docs(spark)
    pairs = {(r["tag_id"], r["ancestor"]) for r in acl.tag_ancestors(tags).collect()}
    assert ("LEAF", "ROOT") in pairs and ("A", "B") in pairs and ("B", "A") in pairs and len(pairs) == 10
    asked = spark.createDataFrame([("ROOT", "LEAF"), ("LEAF", "ROOT")], "tag_id string, new_parent string")
    got = {r["tag_id"]: r["cycle"] for r in acl.would_cycle(asked, acl.tag_ancestors(tags)).collect()}
    assert got == {"ROOT": True, "LEAF": False}


def test_private_text_never_appears(spark):
    files, _ = docs(spark)
    q = spark.createDataFrame([(1, 1, "secret private plan"), (2, 999, "secret private plan"), (3, 1, "search basics")], "query_id bigint, user_id bigint, query string")
    q = q.join(users(spark), "user_id").withColumn("entities", F.array(F.lit("plan"))).withColumn("profile", F.lit("general"))
    chunks = files.withColumns({"sheet": F.lit("plan"), "section": F.lit(None).cast("string")})
    for channel in (R.bm25_channel(chunks, q, 10), R.entity_channel(chunks, q, 10)):
        for r in channel.collect():
            assert not (r["file_md5"] in ("f4", "f6") and r["query_id"] != 2)
    best = {r["query_id"]: r["file_md5"] for r in R.text_scores(chunks, q).orderBy("score").collect()}
    assert best[2] == "f4"


def test_cosine_blocks_and_ties(spark):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(40, 8)).round(3)
    vec[10:30] = vec[10]  # a group of copies
    rows = [(f"f{i:02d}", 0, [float(x) for x in v], ["any"]) for i, v in enumerate(vec)] + [("none", 0, None, ["any"]), ("zero", 0, [0.0] * 8, ["any"])]
    c = spark.createDataFrame(rows, "file_md5 string, chunk_id int, vector array<float>, file_tokens array<string>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], ["any"]) for i in range(9)], "query_id bigint, vector array<float>, tokens array<string>")
    one = sorted(map(tuple, V.cosine_top(c, q, 7).collect()))
    many = sorted(map(tuple, V.cosine_top(c, q, 7, block=2, rows=5).collect()))
    assert one == many and len(one) == 63
    for qid in range(9):
        ranked = [(r[3], r[1]) for r in one if r[0] == qid]
        assert len(ranked) == 7
    copies = [r[1] for r in sorted(one, key=lambda r: r[4]) if r[0] == one[0][0] and "f10" <= r[1] < "f30"]
    assert copies == sorted(copies)


def test_guarded_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([1.0, float("nan")], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r[0] == r[1] for r in df.select(V.guarded_cosine(F.col("a"), F.col("b")), "want").collect())


def test_embedder_keeps_order_and_blanks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", " ", "ccc", "boom", "d"])], "i int, t string").coalesce(1)

    def embedder(texts):
        if "boom" in texts:
            raise ValueError("no")
        return [[float(len(x))] for x in texts]

    got = [(r["vector"], r["embed_status"]) for r in V.embed(df, "t", embedder, 3).orderBy("i").collect()]
    assert got == [([1.0], "indexed"), ([2.0], "indexed"), (None, "skipped"), (None, "error"), (None, "error"), (None, "error")]


def test_single_pass_weights():
    assert R.single_pass_weights(None, None) == (0.7, 0.3)
    assert R.single_pass_weights(-1, 0.5) == (0.7, 0.5)
    assert R.single_pass_weights(0, 0) == (0.7, 0.3)


def test_edges_from_arrows_and_words(spark):
    arrows = [("a", i, "text", t, None, "tika") for i, t in enumerate(["受注 -> 在庫", "在庫 → 出荷", "受注 -> 在庫", "123 -> x"])]
    words = [("w", i, "text", t, None, "tika") for i, t in enumerate(["受注システム", "データを入力する", "在庫システム"])]
    b = spark.createDataFrame(arrows + words, "file_md5 string, block_index int, type string, text string, page int, source_parser string")
    e = G.extract_edges(G.collect_lines(b))
    got = sorted((r["file_md5"], r["src"], r["dst"], r["relation_type"]) for r in e.collect())
    assert got == [("a", "受注", "在庫", "连接"), ("a", "在庫", "出荷", "连接"), ("w", "受注システム", "在庫システム", "输入")]


def test_paths_take_first_edges_among_shortest(spark):
    e = [("f", "e1", "s", "x"), ("f", "e2", "s", "a"), ("f", "e3", "a", "t"), ("f", "e4", "x", "y"), ("f", "e0", "s", "b"), ("f", "e9", "b", "t"), ("f", "e5", "y", "t"), ("f", "e6", "t", "s")]
    edges = spark.createDataFrame(e, "file_md5 string, edge_id string, src string, dst string").withColumn("relation_type", F.lit("r"))
    asked = spark.createDataFrame([(1, "f", "s"), (1, "f", "t")], "search_id int, file_md5 string, node string")
    r = G.one_way(G.shortest_paths(asked, edges)).collect()
    assert len(r) == 1 and list(r[0]["path"]) == ["e0", "e9"] and r[0]["hops"] == 2 and not r[0]["reverse"]


def test_first_paths_equal_all_paths_cut(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{i % 2}", f"e{i:03d}", f"n{a:02d}", f"n{b:02d}") for i, (a, b) in enumerate(rng.integers(0, 24, (50, 2)))]
    edges = spark.createDataFrame(rows, "file_md5 string, edge_id string, src string, dst string")
    asked = spark.createDataFrame(
        [(s, f"f{f}", f"n{n:02d}") for s in (1, 2) for f in (0, 1) for n in range(s, 24, 2)], "search_id int, file_md5 string, node string")
    step = {}
    for f, e, a, b in rows:
        step.setdefault((f, a), []).append((e, b))

    def best(f, start):
        """Fewest hops, then first in edge order, to every node."""
        seen, front = {start: ()}, {start: ()}
        for _ in range(6):
            grown = {}
            for here, path in front.items():
                for e, b in step.get((f, here), []):
                    if b not in seen and (b not in grown or (*path, e) < grown[b]):
                        grown[b] = (*path, e)
            seen |= grown
            front = grown
        return {k: v for k, v in seen.items() if v}

    want = set()
    for s, f, n in asked.collect():
        for target, path in best(f, n).items():
            if (s, f, target) in {tuple(r) for r in asked.collect()}:
                want.add((s, f, n, target, path))
    got = {(r["search_id"], r["file_md5"], r["start"], r["target"], tuple(r["path"])) for r in G.shortest_paths(asked, edges).collect()}
    assert got == want and max(len(w[4]) for w in want) > 3
    row = lambda r: (r["search_id"], r["file_md5"], r["low"], r["high"], r["reverse"], tuple(r["path"]))
    every = sorted(row(r) for r in G.one_way(G.shortest_paths(asked, edges)).collect())
    few = sorted(row(r) for r in G.first_paths(asked, edges, 2).collect())
    for s in (1, 2):
        assert [r for r in few if r[0] == s][:2] == [r for r in every if r[0] == s][:2]


def test_paths_through_a_hub(spark):
    """100,000 edges at one node and 1,000 asked nodes: only the first pairs are formed."""
    n = F.col("id")
    into = spark.range(50_000).select(F.lit("f").alias("file_md5"), F.format_string("i%06d", n).alias("edge_id"), F.format_string("a%06d", n).alias("src"), F.lit("hub").alias("dst"))
    out = spark.range(50_000).select(F.lit("f").alias("file_md5"), F.format_string("o%06d", n).alias("edge_id"), F.lit("hub").alias("src"), F.format_string("b%06d", n).alias("dst"))
    asked = spark.range(1_000).select(F.lit(1).alias("search_id"), F.lit("f").alias("file_md5"), F.when(n % 2 == 0, F.format_string("a%06d", n)).otherwise(F.format_string("b%06d", n)).alias("node"))
    r = G.first_paths(asked, into.unionByName(out), 6).orderBy("low", "high").limit(6).collect()
    assert [(x["low"], x["high"], list(x["path"])) for x in r] == [("a000000", f"b{i:06d}", ["i000000", f"o{i:06d}"]) for i in range(1, 12, 2)]


def test_first_readable_is_enough(spark):
    rows = spark.createDataFrame([(f"f{i % 7}", i) for i in range(60)], "file_md5 string, id int")
    files = spark.createDataFrame([(f"f{i}", ["any", f"t:{i % 3}", "public"] if i % 2 else ["any", f"t:{i % 3}"]) for i in range(6)], "file_md5 string, file_tokens array<string>")
    users = spark.createDataFrame([(1, ["any"]), (2, ["public", "t:0"]), (3, ["t:1"]), (4, ["none"])], "user_id int, tokens array<string>")
    met = acl.first_readable(rows, users, files, [], [F.col("id")], 5, ["user_id", "file_md5", "id"]).collect()
    tokens, held = dict(files.collect()), dict(users.collect())
    for user, mine in held.items():
        want = [i for f, i in sorted(map(tuple, rows.collect()), key=lambda r: r[1]) if set(tokens.get(f, [])) & set(mine)][:5]
        assert sorted(r["id"] for r in met if r["user_id"] == user)[:5] == want
    all_rows = users.select("user_id").join(rows, F.lit(True)).select("user_id", "file_md5", "id")
    assert acl.readable_rows(all_rows, users, files, "user_id").filter("user_id = 4").count() == 0


def test_zero_scores_stand_before_negative_cosines(spark):
    chunks = spark.createDataFrame([("f", i, ["any"], f"w{i}") for i in range(4)], "file_md5 string, chunk_id int, file_tokens array<string>, text_content string")
    vectors = spark.createDataFrame([("f", 0, [-1.0, 0.0], ["any"]), ("f", 1, [1.0], ["any"])], "file_md5 string, chunk_id int, vector array<float>, file_tokens array<string>")
    q = spark.createDataFrame([(1, [1.0, 0.0], ["any"]), (2, None, ["any"])], "query_id int, vector array<float>, tokens array<string>")
    got = sorted(map(tuple, R._without_vector(chunks, vectors, q, 3).collect()))
    assert {g[2] for g in got if g[0] == 1} == {1, 2, 3} and {g[2] for g in got if g[0] == 2} >= {0, 1, 2}
