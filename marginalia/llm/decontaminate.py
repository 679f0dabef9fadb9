"""Benchmark passages in training texts, found through an FM-index of each training shard.

A shard is a block of documents inside a task. Its words become symbols: one for each word that the benchmark uses, and a
barrier for every other word and every end of a document. The suffixes of the shard are sorted (by triples of symbols, then
doubling the length only where suffixes still tie), the symbols before them form the Burrows-Wheeler transform, and a
wavelet matrix answers how often a symbol stands before a row. Every window of 13 words of a benchmark item, or a shorter
item as a whole, is searched backwards, all windows of the block at once. Places come from sampled suffix positions: every
eighth position and every one behind a barrier is kept, other rows step back to the next. Barriers order by place, so no
match and no step crosses one. Words are compared by a 64-bit hash; every match is proven on the words themselves.

The benchmark is the stated query set: it goes to the tasks in blocks of at most ``PHRASE_BYTES`` of text, each block in a
pass of its own over the documents. Hits of all passes are merged.

Defined cases: a null or empty text, or item, has no words; an item without words occurs nowhere; a null item_id counts as
the item named ""; repeated items count once; repeated documents get the same result; columns with the names of results are
replaced, others are kept.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import add_columns, aside, back
from marginalia.session import stored

WINDOW, SAMPLE = 13, 8
#: Bytes of text in a shard's index (one document at least), and of benchmark text in one pass.
SHARD_BYTES, PHRASE_BYTES = 4 << 20, 2 << 20
#: A-Z to lower case; what is no letter, figure or part of a longer character to a blank.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
END = b"\x01"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, base, np.uint64))) for base in (BASE, INVERSE)]
    return _POWERS


class Words:
    """The words of several texts: places in the joined bytes, hashes, and the text each belongs to."""

    def __init__(self, raw: list[bytes]):
        self.body = END.join([r.translate(WORD_BYTES) for r in raw]) + END
        data = np.frombuffer(self.body, np.uint8)
        inside = (data != 32) & (data != 1)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.append(0, edge) if len(inside) and inside[0] else edge
        self.start, self.end = edge[0::2], edge[1::2]
        self.offset = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        self.first = np.searchsorted(self.start, self.offset)  # number of the first word of each text
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        up, down = _powers(len(data) + 1)
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)]))
        h = (total[self.end] - total[self.start]) * down[self.start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.hash = h ^ (h >> np.uint64(29))

    def text(self, i: int, n: int) -> bytes:
        """n words from the i-th, joined by blanks."""
        return b" ".join(self.body[self.start[i]:self.end[i + n - 1]].split())


class Phrases:
    """The windows of benchmark items, as rows of symbols that end in the last column."""

    def __init__(self, items: list[tuple[str, str]]):
        of: dict[bytes, set[str]] = {}
        for item, text in items:
            words = text.encode().translate(WORD_BYTES).split()
            for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
                of.setdefault(b" ".join(words[i:i + WINDOW]), set()).add(item)
        self.windows, self.items = list(of), [sorted(v) for v in of.values()]
        split = [w.split() for w in self.windows]
        known = sorted({w for words in split for w in words})
        hashes = Words(known).hash if known else np.array([], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        code = np.empty(len(known), np.int64)
        code[order] = np.arange(1, len(known) + 1)
        number = dict(zip(known, code.tolist()))
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.codes = np.zeros((len(split), WINDOW), np.int64)
        for i, words in enumerate(split):
            self.codes[i, WINDOW - len(words):] = [number[w] for w in words]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for words of no window."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order. Ranks of barriers are unique, so suffixes differ at a barrier at the latest."""
    n = len(ranks)
    bits = max(1, int(ranks.max()).bit_length())
    width = max(1, min(3, 63 // bits))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[:n - k] |= ranks[k:]
    order = np.argsort(key, kind="stable")
    fresh = np.append(True, key[order][1:] != key[order][:-1])
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        if not len(tied):
            return order
        place = order[tied]
        follow = rank[np.minimum(place + width, n - 1)]
        key = group[tied] * np.int64(n) + follow
        by = np.argsort(key, kind="stable")
        order[tied] = place[by]
        key = key[by]
        fresh[tied] = np.append(True, key[1:] != key[:-1])
        group[tied] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        rank[order[tied]] = group[tied]
        width *= 2


class Wavelet:
    """Wavelet matrix: counts of a symbol before a place, and the symbol at a place."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (values >> shift) & 1 == 1
            self.levels.append((shift, np.append(0, np.cumsum(ones, dtype=np.int32)), int(len(ones) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            before = ones[place]
            place = np.where((symbol >> shift) & 1 == 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.base[symbol]

    def step(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and how many of it stand before."""
        symbol = np.zeros(len(place), np.int64)
        for shift, ones, zeros in self.levels:
            before = ones[place]
            one = ones[place + 1] > before
            symbol |= one.astype(np.int64) << shift
            place = np.where(one, zeros + before, place - before)
        return symbol, place - self.base[symbol]


class Index:
    """FM-index of a sequence of symbols; 0 is a barrier and stands at the end."""

    def __init__(self, symbols: np.ndarray, top: int):
        barrier = symbols == 0
        n, barriers = len(symbols), int(barrier.sum())
        order = suffix_array(np.where(barrier, np.cumsum(barrier) - 1, barriers + symbols - 1))
        before = np.where(order > 0, symbols[order - 1], 0)
        self.start = np.append(0, np.cumsum(np.bincount(symbols, minlength=top + 1)))
        self.tree = Wavelet(before, top)
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.number, self.place, self.n = kept, np.cumsum(kept) - 1, order[kept], n

    def search(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of codes at once: (row, first, end) of those that occur."""
        row = np.arange(len(codes))
        low, high = self.start[codes[:, -1]], self.start[codes[:, -1] + 1]
        done = []
        for k in range(1, codes.shape[1] + 1):
            alive = high > low
            row, low, high = row[alive], low[alive], high[alive]
            whole = sizes[row] == k
            done.append((row[whole], low[whole], high[whole]))
            row, low, high = row[~whole], low[~whole], high[~whole]
            if not len(row):
                break
            symbol = codes[row, codes.shape[1] - 1 - k]
            low, high = (self.start[symbol] + self.tree.rank(symbol, at) for at in (low, high))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of index rows: step back to a sampled one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            found = self.kept[at]
            out[left[found]] = self.place[self.number[at[found]]] + steps[left[found]]
            left, at = left[~found], at[~found]
            symbol, before = self.tree.step(at)
            rows[left] = self.start[symbol] + before
            steps[left] += 1
        return out


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every place where a window occurs in one text."""
    none = np.array([], np.int64), np.array([], np.int64)
    if not len(words.hash) or not phrases.windows:
        return none
    symbols = np.insert(phrases.symbols(words.hash), words.first[1:], 0)  # a barrier ends every text
    number = np.insert(np.arange(len(words.hash)), words.first[1:], -1)
    used = (symbols > 0) | (np.append(0, symbols[:-1]) > 0)  # of several barriers in a row one is enough
    symbols, number = symbols[used], number[used]
    if not len(symbols):
        return none
    index = Index(symbols, len(phrases.hashes))
    window, low, high = index.search(phrases.codes, phrases.sizes)
    if not len(window):
        return none
    count = high - low
    rows = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    window = np.repeat(window, count)
    word = number[index.locate(rows)]
    proven = np.fromiter((words.text(w, int(phrases.sizes[v])) == phrases.windows[v] for w, v in zip(word.tolist(), window.tolist())), bool, len(word))
    return word[proven], window[proven]


def judge(raw: list[bytes], phrases: Phrases, earlier: list[tuple[list, list]] | None = None) -> list[tuple]:
    """For each text: number of words, of hit words, items, spans of hit words, and the same in bytes of the text."""
    words = Words(raw)
    word, window = occurrences(words, phrases)
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + phrases.sizes[window], -1)
    items: list[set] = [set() for _ in raw]
    for d, v in set(zip(words.doc[word].tolist(), window.tolist())):
        items[d].update(phrases.items[v])
    for d, (spans, found) in enumerate(earlier or []):
        items[d].update(found)
        for s, e in spans:
            change[words.first[d] + s] += 1
            change[words.first[d] + e] -= 1
    hit = np.cumsum(change[:-1]) > 0
    total = np.append(0, np.cumsum(hit))
    out = []
    for d, (a, b) in enumerate(pairwise(words.first.tolist())):
        spans, places = [], []
        if total[b] > total[a]:
            own = np.concatenate([[False], hit[a:b], [False]])
            edge = np.flatnonzero(own[1:] != own[:-1]).tolist()
            spans = list(zip(edge[0::2], edge[1::2]))
            places = [(int(words.start[a + s] - words.offset[d]), int(words.end[a + e - 1] - words.offset[d])) for s, e in spans]
        out.append((b - a, int(total[b] - total[a]), sorted(items[d]), spans, places))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
          T.StructField("hit_words", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))]


def phrase_blocks(benchmark: DataFrame, phrase_bytes: int = PHRASE_BYTES):
    """The benchmark's items in blocks of bounded size."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text")).where("text IS NOT NULL").distinct()
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > phrase_bytes:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    yield held


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
         phrase_bytes: int = PHRASE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns and n_words, n_hit, items, hit_words (spans in words) and spans (in code points, end exclusive)."""
    out, columns = docs, list(docs.columns if keep is None else keep)
    names = [f.name for f in FIELDS]
    columns = [c for c in columns if c not in names]
    out = docs.select(*dict.fromkeys([*columns, text]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for number, block in enumerate(phrase_blocks(benchmark, phrase_bytes)):
        if number:
            out = stored(out, "decontaminate")
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(block))

        def make(sent=sent, more=number > 0):
            def compute(batch):
                raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
                old = [([(s["start"], s["end"]) for s in w], i) for w, i in zip(batch.column("hit_words").to_pylist(), batch.column("items").to_pylist())] if more else None
                rows, at = [], 0
                while at < len(raw):
                    end, size = at + 1, len(raw[at])
                    while end < len(raw) and size + len(raw[end]) <= shard_bytes:
                        size += len(raw[end])
                        end += 1
                    rows += judge(raw[at:end], sent.value, old[at:end] if more else None)
                    at = end
                points = [[{"start": len(r[:s].decode()), "end": len(r[:e].decode())} for s, e in row[4]] for r, row in zip(raw, rows)]
                return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.list_(pa.string())),
                        pa.array([[{"start": s, "end": e} for s, e in r[3]] for r in rows], span), pa.array(points, span)]

            return compute

        out = add_columns(out, make, FIELDS)
    return out.select(*columns, *names)


def contaminated():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def without(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the contamination rule keeps, with their columns."""
    own, names = aside(docs)
    return back(find(own, benchmark, names[text]).where(~contaminated()), names)


def removed(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All documents, with the found spans cut out of their texts."""
    rest = F.expr(f"""aggregate(reverse(spans), coalesce({text}, ''),
        (t, s) -> concat(substring(t, 1, cast(s.start as int)), substring(t, cast(s.end as int) + 1)))""")
    return find(docs, benchmark, text).withColumn(text, F.when(F.col(text).isNotNull(), rest))


def op7(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs.select("doc_id", "text"), benchmark, keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: The contract by plain comparison of windows.
SQL = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS l FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::varchar, '') AS item, {_words('text')} AS l FROM benchmark),
w AS (SELECT item, len(s) AS n, array_to_string(s, ' ') AS k FROM (
  SELECT item, unnest(list_transform(range(1, greatest(len(l) - {WINDOW - 1}, 1) + 1), lambda i: l[i:i + {WINDOW - 1}])) AS s FROM b WHERE len(l) > 0)),
p AS (SELECT doc_id, n, l, unnest(range(1, len(l) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w)),
h AS (SELECT DISTINCT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(l[i:i + n - 1], ' ') AS k FROM p) JOIN w USING (n, k)),
t AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM h GROUP BY 1)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)
"""

