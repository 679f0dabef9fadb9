"""Access control as tokens, and the organisation tag tree.

A file carries the tokens that open it (its owner, 'public', its tag and the tag's ancestors,
'any'); a user carries the tokens they own (themselves, 'public', DEFAULT, their tags, and 'any'
for admins). Access means the two sets overlap. Ancestors are few, descendants may be many, so
the tree is expanded on the file side.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import constants as C
from marginalia.functions.text import comma_list
from marginalia.plans.joins import PAIR_ROWS, many_to_many
from marginalia.plans.sequence import top_rows
from marginalia.session import cut, stored

PUBLIC, ANY = "public", "any"
#: Rows per term and token that a task holds at most.
HELD = 1 << 21


def tag_ancestors(tags: DataFrame) -> DataFrame:
    """(tag_id, ancestor, depth), each tag its own ancestor at depth 0; cycles end.

    One join per tree level; every level is checkpointed, and new pairs only are kept.
    """
    parents = tags.filter(F.col("parent_tag").isNotNull()).select(
        F.col("tag_id").alias("_child"), F.col("parent_tag").alias("_parent")
    )
    seen = tags.select("tag_id", F.col("tag_id").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = (
            frontier.join(parents, frontier["ancestor"] == parents["_child"])
            .select("tag_id", F.col("_parent").alias("ancestor"), F.lit(depth).alias("depth"))
            .distinct()
            .join(seen.select("tag_id", "ancestor"), ["tag_id", "ancestor"], "left_anti")
        )
        frontier = cut(step)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def would_cycle(proposals: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Flag (tag_id, new_parent) when the tag is above or equal to its new parent."""
    above = ancestors.select(F.col("tag_id").alias("new_parent"), F.col("ancestor").alias("_above"))
    hit = proposals.join(above, "new_parent").filter("tag_id = _above").select("tag_id", "new_parent").distinct()
    return proposals.join(hit.withColumn("cycle", F.lit(True)), ["tag_id", "new_parent"], "left").withColumn(
        "cycle", F.coalesce("cycle", F.lit(False))
    )


def tag_paths(tags: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Depth, root path and number of children per tag (the nested tree, level by level)."""
    chain = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor")))
    path = ancestors.groupBy("tag_id").agg(
        F.max("depth").alias("depth"), F.array_join(chain["ancestor"], "/").alias("path")
    )
    children = tags.groupBy(F.col("parent_tag").alias("tag_id")).agg(F.count("*").alias("n_children"))
    return path.join(children, "tag_id", "left").fillna(0, ["n_children"])


def nested_tree(tags: DataFrame) -> DataFrame:
    """(tag_id, tree) for every root: the tags below it as nested JSON, children in the order of their ids.

    The tree is walked down level by level and folded up again; only levels are counted on the driver. Tags that hang below no
    root (in a cycle, or below a parent that does not exist) are left out; see ``unrooted_tags``.
    """
    levels = _levels(tags)
    below = None
    for level in reversed(levels):
        node = level.join(below, "tag_id", "left") if below is not None else level.withColumn("children", F.lit(None).cast("string"))
        head = F.to_json(F.struct(F.col("tag_id").alias("tagId")))
        tree = F.concat(F.left(head, F.length(head) - 1), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        done = node.select("tag_id", "parent_tag", tree.alias("tree"))
        listed = F.array_sort(F.collect_list(F.struct("tag_id", "tree")))
        below = cut(done.groupBy(F.col("parent_tag").alias("tag_id")).agg(F.array_join(F.transform(listed, lambda x: x["tree"]), ",").alias("children")))
    return done.select("tag_id", "tree") if levels else tags.select("tag_id", F.lit("").alias("tree")).limit(0)


def _levels(tags: DataFrame) -> list[DataFrame]:
    own = tags.select("tag_id", "parent_tag")
    level, out = cut(own.filter("parent_tag IS NULL")), []
    while not level.isEmpty():
        out.append(level)
        level = cut(own.join(level.select(F.col("tag_id").alias("parent_tag")), "parent_tag").select("tag_id", "parent_tag"))
    return out


def unrooted_tags(tags: DataFrame) -> DataFrame:
    """Tags that no root leads to."""
    out = tags.select("tag_id", "parent_tag")
    for level in _levels(tags):
        out = out.join(level.select("tag_id"), "tag_id", "left_anti")
    return out


def user_tokens(role: Column, user_id: Column, org_tags: Column) -> Column:
    base = F.array(
        F.concat(F.lit("u:"), user_id.cast("string")), F.lit(PUBLIC), F.lit(f"t:{C.DEFAULT_TAG}")
    )
    tags = F.transform(comma_list(org_tags), lambda t: F.concat(F.lit("t:"), t))
    return F.when(role == C.ADMIN_ROLE, F.array(F.lit(ANY))).otherwise(F.array_distinct(F.concat(base, tags)))


def with_file_tokens(files: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Add `file_tokens`; the tag table joins by tag, unknown tags stand for themselves."""
    up = ancestors.groupBy(F.col("tag_id").alias("org_tag")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("t:"), "ancestor"))).alias("_up")
    )
    own = F.array_compact(
        F.array(
            F.lit(ANY), F.concat(F.lit("u:"), F.col("user_id").cast("string")),
            F.when(F.col("is_public"), PUBLIC), F.concat(F.lit("t:"), F.col("org_tag")),
        )
    )
    up_tags = F.coalesce("_up", F.array().cast("array<string>"))
    return (
        files.join(up, "org_tag", "left")
        .withColumn("file_tokens", F.array_distinct(F.concat(own, up_tags)))
        .drop("_up")
    )


def can_read(file_tokens: Column, user_tokens_col: Column) -> Column:
    return F.arrays_overlap(file_tokens, user_tokens_col)


def readable_files(users: DataFrame, files: DataFrame, pairs: int = PAIR_ROWS) -> DataFrame:
    """(user_id, file_md5) pairs, each once.

    Files with the same tokens are read by the same users, and users who hold the same tokens of any
    file read the same files. Access is settled between such groups, at their first common token;
    then the groups that match are expanded, which needs no test per pair and no distinct.
    """
    names = F.array_sort(F.array_distinct("file_tokens"))
    f = files.select("file_md5", F.to_json(names).alias("_files"), names.alias("_tokens"))
    kinds = f.groupBy("_files").agg(F.first("_tokens").alias("_tokens")).select("_files", "_tokens", F.explode("_tokens").alias("_token"))
    mine = users.select("user_id", F.explode(F.array_distinct("tokens")).alias("_token"))
    mine = mine.join(kinds.select("_token").distinct(), "_token", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_list("_token")).alias("_have"))
    mine = stored(mine.select("user_id", F.to_json("_have").alias("_users"), "_have"), "user-kinds")
    groups = mine.groupBy("_users").agg(F.first("_have").alias("_have")).select("_users", "_have", F.explode("_have").alias("_token"))
    met = kinds.join(groups, "_token").filter(F.col("_token") == F.element_at(F.array_intersect("_tokens", "_have"), 1))
    rows = stored(f.select("file_md5", "_files").join(met.select("_files", "_users"), "_files").drop("_files"), "files-by-user-kind")
    return many_to_many(rows, mine.select("user_id", "_users"), "_users", pairs).select("user_id", "file_md5")


def user_tags(users: DataFrame, ancestors: DataFrame, pairs: int = PAIR_ROWS) -> DataFrame:
    """(user_id, tag_id): a user's own tags, the tags below these, and the default tag, each once.

    Users with the same tags reach the same tags: these are made distinct once per set of tags, then given to its users.
    """
    own = users.select("user_id", F.array_sort(F.array_distinct(comma_list(F.col("org_tags")))).alias("_tags"))
    own = stored(own.select("user_id", F.to_json("_tags").alias("_kind"), "_tags"), "user-tags")
    kinds = own.groupBy("_kind").agg(F.first("_tags").alias("_tags"))
    down = kinds.select("_kind", F.explode("_tags").alias("ancestor")).join(ancestors, "ancestor").select("_kind", "tag_id")
    every = kinds.select("_kind", F.explode(F.array_append("_tags", F.lit(C.DEFAULT_TAG))).alias("tag_id")).unionByName(down)
    reach = stored(every.distinct(), "tags-by-kind")
    return many_to_many(own.select("user_id", "_kind"), reach, "_kind", pairs).select("user_id", "tag_id")


def readable_rows(rows: DataFrame, readers: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows (`key`, file_md5, ...) whose reader holds a token of the file; no table of readers and files.

    readers: `key`, tokens; files: file_md5, file_tokens.
    """
    both = rows.join(files.select("file_md5", "file_tokens"), "file_md5").join(readers.select(key, "tokens"), key)
    return both.filter(can_read(F.col("file_tokens"), F.col("tokens"))).select(*rows.columns)


def first_readable(
    rows: DataFrame, readers: DataFrame, files: DataFrame, on: list[str], order: list[Column], k: int, unique: list[str],
    within: list[str] | None = None,
) -> DataFrame:
    """Rows with every column of their readers, enough to hold each reader's first k rows in `order`.

    Rows are cut to the first k per `on` and file, then per `on` and token, and meet the readers by
    token, so a reader meets at most k rows per token however many files it may read. `unique`
    names the columns that tell reader and row apart; a row met through two tokens stays once.
    With `within` the cut is made for each value of these columns of the rows.
    """
    kinds = [*on, *(within or [])]
    per_file = top_rows(rows, [*kinds, "file_md5"], order, k, "_r").drop("_r")
    tokens = files.select("file_md5", F.explode("file_tokens").alias("_token"))
    few = top_rows(per_file.join(tokens, "file_md5"), [*kinds, "_token"], order, k, "_r").drop("_r")
    mine = readers.withColumn("_token", F.explode(F.array_distinct("tokens"))).drop("tokens")
    return mine.join(few, [*on, "_token"]).drop("_token").dropDuplicates(unique)


def first_of_task(rows: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """(term, *key, order) of rows (*key, order, file_tokens, terms): those among the first k of a term and a token in their task.

    What `first_readable` cuts to the first k per term and token needs no other row, so a word that most texts hold brings a
    few rows per task instead of all; nothing is shuffled or sorted for that. `order` is a struct, nulls first. A task that
    comes to hold `HELD` rows gives them away and goes on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    own = [*key, order]
    out = StructType([StructField("term", StringType()), *[rows.schema[c] for c in own]])

    def run(batches):
        schema = to_arrow_schema(out)
        best: dict[str, dict[str, list]] = {}
        seen = held = 0

        def given():
            kept = [(term, row) for term, tokens in best.items() for row in {e[1]: e[2] for few in tokens.values() for e in few}.values()]
            for at in range(0, len(kept), 10_000):
                some = kept[at:at + 10_000]
                columns = [[term for term, _ in some], *[[row[i] for _, row in some] for i in range(len(own))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*own, "file_tokens", "terms")]
            for *row, tokens, terms in zip(*columns):
                seen += 1
                entry = (tuple((v is not None, v) for v in (row[-1] or {}).values()), seen, row)
                for term in terms:
                    few_of = best.setdefault(term, {})
                    for token in tokens or ():
                        few = few_of.get(token)
                        if few is None:
                            few = few_of[token] = []
                        if len(few) < k:
                            insort(few, entry)
                            held += 1
                        elif entry < few[-1]:
                            insort(few, entry)
                            few.pop()
                if held > HELD:
                    yield from given()
                    best, held = {}, 0
        yield from given()

    return rows.select(*own, "file_tokens", "terms").mapInArrow(run, out)


def newest_files(users: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """The n newest readable files per user; every token is cut to its own n newest first."""
    newest = [F.col("created_at").desc(), F.col("file_md5")]
    per_token = top_rows(
        files.select("file_md5", "created_at", F.explode("file_tokens").alias("token")),
        ["token"], newest, n, "_r",
    ).drop("_r")
    mine = users.select("user_id", F.explode("tokens").alias("token"))
    pairs = per_token.join(mine, "token").select("user_id", "file_md5", "created_at").distinct()
    return top_rows(pairs, ["user_id"], newest, n)


def missing_tags(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Assigned tags that do not exist."""
    return assignments.join(tags.select(F.col("tag_id").alias("tag")), "tag", "left_anti")


def primary_org(tags: Column, wanted: Column) -> Column:
    """A single tag becomes primary, no tag clears it, otherwise the wanted one if assigned."""
    n = F.size(tags)
    return (
        F.when(n == 1, F.element_at(tags, 1))
        .when((n > 1) & F.array_contains(tags, wanted), wanted)
    )


def tags_in_use(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per tag, whether users carry it or children hang below it (whole elements, not substrings)."""
    used = assignments.select(F.col("tag").alias("tag_id")).distinct().withColumn("has_users", F.lit(True))
    kids = (
        tags.filter("parent_tag is not null").select(F.col("parent_tag").alias("tag_id")).distinct()
        .withColumn("has_children", F.lit(True))
    )
    out = tags.select("tag_id").join(used, "tag_id", "left").join(kids, "tag_id", "left")
    return out.fillna(False, ["has_users", "has_children"])


def owned_conversations(listed: DataFrame, current: DataFrame, archived: DataFrame) -> DataFrame:
    """(user_id, conversation_id) owned in any of three ways."""
    cols = ["user_id", "conversation_id"]
    return listed.select(cols).unionByName(current.select(cols)).unionByName(archived.select(cols)).distinct()
