"""Registered queries: access control, tag tree, file listings, plain filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import acl
from marginalia.plans.oracle import with_tables
from marginalia.plans.sequence import top_rows
from marginalia.plans.tables import Tables


def users_with_tokens(t: Tables):
    u = t.users()
    return u.select("user_id", "role", acl.user_tokens(F.col("role"), F.col("user_id"), F.col("org_tags")).alias("tokens"))


def files_with_tokens(t: Tables, files=None):
    return acl.with_file_tokens(files if files is not None else t.files(), acl.tag_ancestors(t.org_tags()))


def readable(t: Tables):
    return acl.readable_files(users_with_tokens(t), files_with_tokens(t))


def newest(t: Tables):
    return acl.newest_files(users_with_tokens(t), files_with_tokens(t), 10)


def own_files(t: Tables):
    f = t.files().filter("status = 3")
    return top_rows(f, ["user_id"], [F.col("created_at").desc(), F.col("file_md5")], 5).select(
        "user_id", "file_md5", "rank"
    )


def delete_rights(t: Tables):
    asked = t.raw("events").select("event_id", F.col("user_id").alias("asker"), (F.col("event_id") % 1000).alias("doc_id"))
    f = t.raw("documents").select("doc_id", (F.col("doc_id") % 20 + 1).alias("owner"))
    u = t.users().select(F.col("user_id").alias("asker"), "role")
    ok = (F.coalesce("role", F.lit("")) == "ADMIN") | (F.col("asker") == F.col("owner"))
    return asked.join(f, "doc_id").join(u, "asker", "left").select("event_id", ok.alias("may_delete"))


def scope_filters(t: Tables):
    wanted = t.raw("labels").filter("quality = 1").select(F.md5(F.col("doc_id").cast("string")).alias("file_md5"))
    f = t.files().filter(F.col("kb_profile").isin("design", "ops") & (F.col("user_id") <= 10))
    return f.join(wanted, "file_md5", "left_semi").select("file_md5", "user_id", "kb_profile")


def closure(t: Tables):
    a = acl.tag_ancestors(t.org_tags())
    return a.select(F.col("ancestor").alias("tag_id"), F.col("tag_id").alias("descendant"), "depth")


def user_reach(t: Tables):
    return acl.user_tags(t.users(), acl.tag_ancestors(t.org_tags()))


def cycles(t: Tables):
    n = F.col("n_nationkey")
    asked = t.raw("nation").select(
        F.concat(F.lit("N"), n).alias("tag_id"),
        F.when(n % 3 == 0, F.concat(F.lit("R"), n % 5)).otherwise(F.concat(F.lit("N"), n - n % 2)).alias("new_parent"),
    ).unionByName(
        t.raw("supplier").select(
            F.concat(F.lit("R"), F.col("s_suppkey") % 5).alias("tag_id"),
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("new_parent"),
        )
    )
    return acl.would_cycle(asked, acl.tag_ancestors(t.org_tags()))


def tree(t: Tables):
    return acl.tag_paths(t.org_tags(), acl.tag_ancestors(t.org_tags()))


def _assignments(t: Tables):
    return t.users().select("user_id", F.explode(F.split("org_tags", ",")).alias("tag")).select(
        "user_id", F.trim("tag").alias("tag")
    ).filter("tag <> ''")


def tag_use(t: Tables):
    return acl.tags_in_use(t.org_tags(), _assignments(t))


def tag_integrity(t: Tables):
    bad = acl.missing_tags(
        _assignments(t).unionByName(t.users().select("user_id", F.concat(F.lit("S"), F.col("user_id") * 7).alias("tag"))),
        t.org_tags(),
    )
    n_bad = bad.groupBy("user_id").agg(F.count("*").alias("n_missing"))
    tags = F.filter(F.transform(F.split("org_tags", ","), lambda x: F.trim(x)), lambda x: x != "")
    tags = F.when(F.col("user_id") % 3 == 0, F.slice(tags, 1, 1)).otherwise(tags)
    wanted = F.concat(F.lit("S"), F.col("user_id") % 4)
    return (
        t.users().select("user_id", F.coalesce(acl.primary_org(tags, wanted), F.lit("-")).alias("primary_org"))
        .join(n_bad, "user_id", "left").fillna(0, ["n_missing"])
    )


def tag_options(t: Tables):
    opts = t.org_tags().unionByName(
        t.raw("supplier").select(
            F.concat(F.lit("PRIVATE_"), F.col("s_name")).alias("tag_id"), F.lit(None).cast("string").alias("parent_tag")
        )
    )
    return opts.filter(~F.col("tag_id").like("PRIVATE\\_%")).select("tag_id").orderBy("tag_id")


def user_pages(t: Tables, page: int = 3, size: int = 20):
    """One page of a listing with its total; the order is total, so pages are stable."""
    base = t.raw("customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    total = base.agg(F.count("*").alias("total")).scalar()
    rows = base.orderBy(F.col("c_acctbal").desc(), "c_custkey").offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size))


def ownership(t: Tables):
    m = t.messages()
    listed = m.filter("seq = 0").select("user_id", "conversation_id")
    current = m.filter("role = 'assistant'").groupBy("user_id").agg(F.max("conversation_id").alias("conversation_id"))
    archived = m.filter("role = 'system'").select((F.col("user_id") + 1).alias("user_id"), "conversation_id")
    return acl.owned_conversations(listed, current, archived)


QUERIES = {
    "p01_readable_files": (readable, with_tables("SELECT user_id, file_md5 FROM visible")),
    "p02_delete_rights": (delete_rights, """SELECT event_id, (coalesce(e.user_id = 1, false) OR e.user_id = d.doc_id % 20 + 1) AS may_delete
      FROM events e JOIN documents d ON e.event_id % 1000 = d.doc_id"""),
    "p03_scope_filters": (scope_filters, with_tables("""SELECT file_md5, user_id, kb_profile FROM files
      WHERE kb_profile IN ('design', 'ops') AND user_id <= 10 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")),
    "p09_tag_options": (tag_options, with_tables("SELECT tag_id FROM org_tags ORDER BY tag_id")),
    "p13_tags_in_use": (tag_use, with_tables("""SELECT tag_id, tag_id IN (SELECT unnest(tags) FROM users) AS has_users,
      tag_id IN (SELECT parent_tag FROM org_tags WHERE parent_tag IS NOT NULL) AS has_children FROM org_tags""")),
    "p16_tag_integrity": (tag_integrity, with_tables("""SELECT user_id,
      coalesce(CASE WHEN user_id % 3 = 0 THEN tags[1] WHEN list_contains(tags, 'S' || (user_id % 4)) THEN 'S' || (user_id % 4) END, '-') AS primary_org,
      (SELECT count(*) FROM (SELECT unnest(list_append(u.tags, 'S' || (u.user_id * 7))) AS x) WHERE x NOT IN (SELECT tag_id FROM org_tags)) AS n_missing
      FROM users u""")),
    "g09_tag_closure": (closure, with_tables("SELECT root AS tag_id, tag_id AS descendant, depth FROM tag_closure")),
    "g09_user_tags": (user_reach, with_tables("SELECT user_id, tag_id FROM user_tags")),
    "g10_tag_cycles": (cycles, with_tables("""SELECT tag_id, new_parent, EXISTS (SELECT 1 FROM tag_closure c
      WHERE c.root = a.tag_id AND c.tag_id = a.new_parent) AS cycle FROM asked a""", {"asked": """
      SELECT 'N' || n_nationkey AS tag_id, CASE WHEN n_nationkey % 3 = 0 THEN 'R' || (n_nationkey % 5)
        ELSE 'N' || (n_nationkey - n_nationkey % 2) END AS new_parent FROM nation
      UNION ALL SELECT 'R' || (s_suppkey % 5), 'S' || s_suppkey FROM supplier"""})),
    "g11_tag_tree": (tree, with_tables("""SELECT o.tag_id, max(depth) AS depth, string_agg(root, '/' ORDER BY depth DESC) AS path,
      (SELECT count(*) FROM org_tags k WHERE k.parent_tag = o.tag_id) AS n_children
      FROM org_tags o JOIN tag_closure c ON c.tag_id = o.tag_id GROUP BY o.tag_id""")),
    "t04_newest_files": (newest, with_tables("""SELECT user_id, file_md5, created_at, rank FROM (
      SELECT v.user_id, v.file_md5, created_at, row_number() OVER (PARTITION BY v.user_id ORDER BY created_at DESC, v.file_md5) AS rank
      FROM visible v JOIN files f ON v.file_md5 = f.file_md5) WHERE rank <= 10""")),
    "t04_own_files": (own_files, with_tables("""SELECT user_id, file_md5, rank FROM (SELECT user_id, file_md5,
      row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_md5) AS rank FROM files) WHERE rank <= 5""")),
    "a26_paged_listing": (user_pages, """SELECT c_custkey, c_name, c_acctbal,
      (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total,
      ceil((SELECT count(*) FROM customer WHERE c_acctbal > 0) / 20.0)::bigint AS pages
      FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40"""),
    "j21_owned_conversations": (ownership, with_tables("""SELECT DISTINCT user_id, conversation_id FROM messages WHERE seq = 0
      UNION SELECT user_id, max(conversation_id) FROM messages WHERE role = 'assistant' GROUP BY user_id
      UNION SELECT user_id + 1, conversation_id FROM messages WHERE role = 'system'""")),
}
