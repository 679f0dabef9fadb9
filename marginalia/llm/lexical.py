"""Ranked lexical search by MaxScore with pair bounds.

Documents are counted once (``counted``) and indexed in blocks of some thousand (``built``): a block has, for each term, the
list of its documents with their impacts and the largest of them, and for chosen term pairs the intersection list with joint
impacts and the joint maximum. Impacts are final integers, since a term's weight and a document's length factor follow from
corpus statistics gathered before. The index is a table with one row per block; a lost task rebuilds its own blocks.

The index holds the terms and pairs that a query set names, so it is small beside the corpus; the statistics N and L are over
all terms. Pairs stand side by side in the order of document frequency: rare terms seldom meet, so that the bound of a pair,
the largest of its joint maximum and its two single maxima, lies far below the sum of the two.

A query visits a block (``search_block``) if the bounds of its pairs and left-over terms sum to its present k-th best score at
least. Units are sorted by bound; those whose bounds sum to less than the k-th score are not essential and open no documents.
Documents from the essential lists take the rest in descending bounds and are dropped as soon as what is left cannot lift
them. The first block's k-th score starts from the best joint impacts of the intersection lists. Bounds are never below a
score and equal scores are kept, so results are exact. A task hands on its k best documents of each query.

Defined cases: null and empty texts have no terms, count for nothing and are never found; a query without terms finds
nothing; each query row is ranked on its own, also where ids repeat; repeated documents are ranked one by one; equal scores go
by doc_id, nulls last; extra columns are not read; with empty tables there are no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import add_columns
from marginalia.plans.joins import lookup_join
from marginalia.session import ship, stored

K = 10
#: Bytes of query text that one pass over the corpus takes.
QUERY_BYTES = 2 << 20
#: Documents and postings from which a block is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 19
#: A pair is indexed if the rarer of its terms stands in at most this share of the documents.
PAIR_SHARE = 0.25
#: Letters and digits of ASCII, in lower case, and all bytes of other characters are words; the rest divides.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass
class Queries:
    """Queries as lists of term numbers; terms are numbered in the order of their bytes."""

    numbers: list[int]
    terms: list[bytes]
    of: list[np.ndarray]

    @classmethod
    def parsed(cls, rows: list[tuple[int, str]]) -> Queries:
        sets = [(number, set(words((text or "").encode()))) for number, text in rows]
        terms = sorted(set().union(*(s for _, s in sets)))
        at = {t: i for i, t in enumerate(terms)}
        return cls([n for n, _ in sets], terms, [np.array(sorted(at[t] for t in s), np.int64) for _, s in sets])


@dataclass
class Plan:
    """Weights of the terms, statistics, and for each query its terms by document frequency with the pairs among them."""

    documents: int
    length: int
    weight: np.ndarray
    pairs: np.ndarray
    of: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def made(cls, queries: Queries, documents: int, length: int, df: dict[int, int]) -> Plan:
        held = np.array([df.get(i, 0) for i in range(len(queries.terms))], np.int64)
        weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        of = []
        for own in queries.of:
            own = own[held[own] > 0]
            own = own[np.lexsort((own, held[own]))]
            mine = [pairs.setdefault((int(a), int(b)), len(pairs)) for a, b in zip(own[0::2], own[1::2]) if held[a] <= PAIR_SHARE * documents]
            of.append((own, np.array(mine, np.int64)))
        return cls(documents, length, weight, np.array(list(pairs), np.int64).reshape(-1, 2), of)


def counted(docs: DataFrame, queries: Queries, text: str = "text") -> DataFrame:
    """doc_id, n (all terms, with repeats), and of the queries' terms their numbers and counts."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.terms)
    lists = T.ArrayType(T.IntegerType())

    def make():
        at = {t: i for i, t in enumerate(sent.value)}

        def compute(batch):
            n, ends, terms, times = [], [0], [], []
            for raw in batch.column(text).cast(pa.binary()):
                all_ = words(raw.as_py() or b"")
                found = [(at[w], k) for w, k in Counter(all_).items() if w in at]
                n.append(len(all_))
                terms += [i for i, _ in found]
                times += [k for _, k in found]
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]

        return compute

    return add_columns(docs.select("doc_id", text), make, [T.StructField("n", T.LongType()), T.StructField("terms", lists), T.StructField("times", lists)], ["doc_id"])


def statistics(counts: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, all their terms, and documents by term of the queries (as many numbers as these have terms)."""
    documents, length = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    return documents, length, df


@dataclass
class Block:
    """Lists of one block: ``starts`` bounds those of the present ``terms``, ``pair_starts`` those of the present ``pairs``."""

    docs: list
    terms: np.ndarray
    starts: np.ndarray
    post: np.ndarray
    impacts: np.ndarray
    most: np.ndarray
    pairs: np.ndarray
    pair_starts: np.ndarray
    pair_post: np.ndarray
    pair_impacts: np.ndarray
    pair_most: np.ndarray


INDEX = ("docs array<long>, terms array<int>, starts array<int>, post array<int>, impacts array<long>, most array<long>, "
         "pairs array<int>, pair_starts array<int>, pair_post array<int>, pair_impacts array<long>, pair_most array<long>")


def block_of(docs: list, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray, plan: Plan) -> Block:
    """The index of documents given by their lengths and their terms and counts, one document after the other."""
    at = np.repeat(np.arange(len(docs)), np.diff(ends))
    m = 10 + (90 * n * plan.documents) // max(plan.length, 1)
    times = times.astype(np.int64)
    impacts = plan.weight[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[at]))
    order = np.lexsort((at, terms))
    order = order[impacts[order] > 0]
    post, impacts = at[order], impacts[order]
    present, starts = np.unique(terms[order], return_index=True)
    starts = np.append(starts, len(order))
    most = np.maximum.reduceat(impacts, starts[:-1]) if len(present) else impacts
    place = np.full(len(plan.weight) + 1, -1)
    place[present] = np.arange(len(present))
    both = np.flatnonzero((place[plan.pairs] >= 0).all(axis=1))
    dense = np.zeros(len(docs), np.int64)
    lists, joint, kept = [], [], []
    for pair in both.tolist():
        i, j = place[plan.pairs[pair]]
        a, b = slice(starts[i], starts[i + 1]), slice(starts[j], starts[j + 1])
        dense[post[a]] = impacts[a]
        other = dense[post[b]]
        hit = other > 0
        dense[post[a]] = 0
        kept.append(pair)
        lists.append(post[b][hit])
        joint.append(other[hit] + impacts[b][hit])
    sizes = [len(x) for x in lists]
    return Block(docs, present, starts, post, impacts, most, np.array(kept, np.int64), np.append(0, np.cumsum(sizes, dtype=np.int64)),
                 np.concatenate([*lists, np.array([], np.int64)]), np.concatenate([*joint, np.array([], np.int64)]),
                 np.array([x.max() if len(x) else 0 for x in joint], np.int64))


def built(counts: DataFrame, plan: Plan) -> DataFrame:
    """One row per block of the documents that hold a term of the queries."""
    ship(counts.sparkSession)
    sent = counts.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        plan = sent.value
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def closed():
            nonlocal held, docs, postings
            whole = pa.Table.from_batches(held).combine_chunks()
            terms, times = (pa.concat_arrays(whole.column(c).chunks) if whole.column(c).num_chunks > 1 else whole.column(c).chunk(0) for c in ("terms", "times"))
            lengths = np.asarray(pc.list_value_length(terms))
            block = block_of(whole.column("doc_id").to_pylist(), whole.column("n").to_numpy(), np.append(0, np.cumsum(lengths)),
                             np.asarray(terms.flatten()), np.asarray(times.flatten()), plan)
            held, docs, postings = [], 0, 0
            return pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(v) if name != "docs" else v], pa.list_(pa.int64() if name in ("docs", "impacts", "most", "pair_impacts", "pair_most") else pa.int32()))
                 for name, v in vars(block).items()], names=list(vars(block)))

        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("terms"))) if len(batch) else np.array([], np.int64)
            at = 0
            while at < len(batch):
                upto = np.cumsum(sizes[at:at + BLOCK_DOCS - docs]) + postings
                take = max(1, int(np.searchsorted(upto, BLOCK_POSTINGS, "right")))
                take = min(take, len(batch) - at)
                held.append(batch.slice(at, take))
                docs, postings, at = docs + take, int(upto[take - 1]), at + take
                if docs >= BLOCK_DOCS or at < len(batch):
                    yield closed()
        if held:
            yield closed()

    return counts.where(F.size("terms") > 0).select("doc_id", "n", "terms", "times").mapInArrow(run, INDEX)


@dataclass
class Best:
    """The k best documents of a query so far: (score, whether the id is missing, id), best first."""

    rows: list = field(default_factory=list)

    def bar(self, k: int) -> int:
        """What a score has to reach."""
        return self.rows[k - 1][0] if len(self.rows) >= k else 1

    def take(self, scores: np.ndarray, docs: list, k: int) -> None:
        found = [(s, d is None, d or 0) for s, d in zip(scores.tolist(), docs)]
        self.rows = sorted([*self.rows, *found], key=lambda r: (-r[0], r[1], r[2]))[:k]


def search_block(block: Block, place: np.ndarray, pair_place: np.ndarray, plan: Plan, own: np.ndarray, pairs: np.ndarray, best: Best, k: int) -> bool:
    """Take the block's documents that enter the query's k best; False if its bounds ruled the block out.

    ``place`` and ``pair_place``: where a term or a pair stands in the block, -1 if it does not.
    """
    pairs = pair_place[pairs]
    pairs = pairs[pairs >= 0]
    ends = plan.pairs[block.pairs[pairs]]
    single = place[own[~np.isin(own, ends)]]
    single = single[single >= 0]
    paired = place[ends]
    if not len(single) and not len(paired):
        return False
    bound = np.concatenate([np.maximum(block.pair_most[pairs], block.most[paired].max(axis=1, initial=0)), block.most[single]])
    bar = best.bar(k)
    if bound.sum() < bar:
        return False
    units = [*paired.tolist(), *([i] for i in single.tolist())]
    if len(best.rows) < k:  # documents known to reach a score: those of an intersection or a list
        for starts, impacts, which in ((block.pair_starts, block.pair_impacts, pairs), (block.starts, block.impacts, single)):
            for i in which.tolist():
                if starts[i + 1] - starts[i] >= k:
                    bar = max(bar, int(np.partition(impacts[starts[i]:starts[i + 1]], -k)[-k]))
    order = np.argsort(bound, kind="stable")
    reach = np.cumsum(bound[order])
    first = int(np.searchsorted(reach, bar, "left"))
    score = np.zeros(len(block.docs), np.int64)
    for u in order[first:].tolist():
        for i in units[u]:
            at = slice(block.starts[i], block.starts[i + 1])
            score[block.post[at]] += block.impacts[at]
    there = np.flatnonzero(score)
    for step in range(first - 1, -1, -1):
        there = there[score[there] + reach[step] >= bar]
        if not len(there):
            return True
        for i in units[order[step]]:
            post = block.post[block.starts[i]:block.starts[i + 1]]
            at = np.minimum(np.searchsorted(post, there), len(post) - 1)
            score[there] += np.where(post[at] == there, block.impacts[block.starts[i] + at], 0)
    there = there[score[there] >= bar]
    if len(there) > k:  # only those that reach the k-th score here
        there = there[score[there] >= np.partition(score[there], -k)[-k]]
    best.take(score[there], [block.docs[i] for i in there.tolist()], k)
    return True


def searched(index: DataFrame, plan: Plan, numbers: list[int], k: int = K) -> DataFrame:
    """(number, score, doc_id): the k best documents of each query in each task's blocks."""
    ship(index.sparkSession)
    sent = index.sparkSession.sparkContext.broadcast((plan, numbers))

    def run(batches):
        plan, numbers = sent.value
        best = [Best() for _ in numbers]
        place, pair_place = np.full(len(plan.weight), -1), np.full(len(plan.pairs), -1)
        for batch in batches:
            for row in range(len(batch)):
                block = Block(*(batch.column(name)[row].as_py() if name == "docs" else np.asarray(batch.column(name)[row].values) for name in batch.schema.names))
                place[block.terms], pair_place[block.pairs] = np.arange(len(block.terms)), np.arange(len(block.pairs))
                for (own, pairs), found in zip(plan.of, best):
                    search_block(block, place, pair_place, plan, own, pairs, found, k)
                place[block.terms], pair_place[block.pairs] = -1, -1
        rows = [(n, s, None if none else d) for n, found in zip(numbers, best) for s, none, d in found.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["number", "score", "doc_id"])

    return index.mapInArrow(run, "number long, score long, doc_id long")


def query_blocks(numbered: DataFrame, size: int = QUERY_BYTES) -> Iterator[list[tuple[int, str]]]:
    held, total = [], 0
    for number, text in numbered.select("_number", "text").where("text IS NOT NULL").toLocalIterator():
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append((number, text))
        total += len(text)
    if held:
        yield held


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each query's k best documents with a score above 0."""
    spark = docs.sparkSession
    numbered = stored(queries.select("item_id", "text").withColumn("_number", F.monotonically_increasing_id()), "queries")
    found = None
    for block in query_blocks(numbered, query_bytes):
        parsed = Queries.parsed(block)
        counts = stored(counted(docs, parsed, text), "counts")
        plan = Plan.made(parsed, *statistics(counts))
        index = stored(built(counts, plan), "index")
        part = searched(index, plan, parsed.numbers, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "number long, score long, doc_id long")
    order = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = numbered.select(F.col("_number").alias("number"), "item_id")
    return lookup_join(top, items, ["number"]).select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, benchmark)


def _terms(text: str) -> str:
    return (rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


#: The same ranking by scoring every document that shares a term with an item.
SQL = f"""
WITH d AS (SELECT doc_id, {_terms('text')} AS l FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(l))::bigint AS n_terms FROM d WHERE len(l) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark)),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(l) AS n, unnest(l) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS c FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(c)::bigint AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= {K}
"""
