"""Toxicity scores from a counterfactually regularised classifier.

A logistic regression over words and word beginnings that a text contains. Its loss has, besides the labels and the usual
penalty, a counterfactual term: in labelled sentences that name a group of people, the name is swapped for the other names
of its list, and every change of the score that this causes is penalised. So a neutral mention of a group cannot carry
weight of its own, however the labels happen to lean.

The model is fitted on at most ``TRAIN_ROWS`` labelled doc_ids, those with the smallest hash, one text each however many rows
share the doc_id, and uses the ``FEATURES`` features that tell the classes apart best; both bounds are parameters and hold at every size, so what reaches
the driver is bounded. Every text is scored whole.

Defined cases: a null or empty text has no features and scores the base rate; a null doc_id is never held out and never
labelled; rows with null labels are no labels; without both classes among the labels the score is the base rate (0 without
labels); repeated rows get the same score; a column that has the name of a result is replaced.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import add_columns, aside, back, texts
from marginalia.session import ship, stored

TRAIN_ROWS, FEATURES, THRESHOLD = 8_000, 1_500, 0.3
PREFIXES = (3, 4, 5, 6, 7)
#: Words a worker remembers the features of.
MEMORY = 300_000
# Names of groups; each list holds words that can stand for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
WORDS = re.compile(r"[^\W_]+")
SENTENCES = re.compile(r"[^.!?\n]+")
SWAPS = {w: sorted({o for terms in IDENTITY_TERMS if w in terms for o in terms if o != w}) for own in IDENTITY_TERMS for w in own}


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:p] + "*" for p in PREFIXES if p < len(word))]


def _features(words) -> set[str]:
    return {f for w in words for f in features_of(w)}


class _Known(dict):
    """Word to the numbers of the features it has."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(n for f in features_of(word) if (n := self.numbers.get(f)) is not None)
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out
        return out

    def present(self, text: str) -> list[int]:
        found = set(map(self.__getitem__, set(WORDS.findall(text.lower()))))
        return sorted({n for group in found for n in group})


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out quarter, one text for each doc_id.

    Where rows share a doc_id the text with the smallest hash stands for them, chosen before anything is dealt by doc_id.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    return own.groupBy("doc_id").agg(first.alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(train: DataFrame) -> DataFrame:
    """(feature, texts, toxic texts), counted per batch first."""
    schema = "feature string, n long, n_toxic long"

    def count(batches):
        for batch in batches:
            n, toxic = Counter(), Counter()
            for t, y in zip(texts(batch, "text"), batch.column("toxic").to_pylist()):
                found = _features(set(WORDS.findall(t.lower())))
                n.update(found)
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[f] for f in n], pa.int64())],
                names=["feature", "n", "n_toxic"])

    return train.mapInArrow(count, schema).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def swaps_in(text: str, known: _Known) -> list[tuple[list[int], list[int]]]:
    """Features that sentences lose and gain when one group name is swapped for another."""
    out = []
    for sentence in SENTENCES.findall(text.lower()):
        words = WORDS.findall(sentence)
        named = {w for w in words if w in SWAPS}
        for word in sorted(named):
            rest = {n for w in words if w != word for n in known[w]}
            own = set(known[word]) - rest
            for other in SWAPS[word]:
                new = set(known[other]) - rest
                if own ^ new:
                    out.append((sorted(own - new), sorted(new - own)))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, counterfactual: float = 1.0,
        penalty: float = 3e-4, text: str = "text") -> dict:
    """The model: ``bias`` and a weight for each feature."""
    spark = docs.sparkSession
    ship(spark)
    train = stored(training_rows(docs, labels, rows, text), "toxicity")
    total, positive = (int(x or 0) for x in train.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < positive < total:
        rate = positive / total if total else 0.0
        return {"bias": float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))), "weights": {}}
    gap = F.abs(F.col("n_toxic") / positive - (F.col("n") - F.col("n_toxic")) / (total - positive))
    spread = F.sqrt(F.col("n") / total * (1 - F.col("n") / total) + 1e-4)
    chosen = [r[0] for r in _counts(train).where("n >= 3").orderBy((gap / spread).desc(), "feature").limit(features).collect()]
    chosen += [f for f in sorted({f for w in SWAPS for f in features_of(w)}) if f not in set(chosen)]
    numbers = {f: i for i, f in enumerate(chosen)}
    schema = "toxic int, present array<int>"

    def encode(batches):
        known = _Known(numbers)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([known.present(t) for t in texts(batch, "text")], pa.list_(pa.int32()))], names=["toxic", "present"])

    def swap(batches):
        known = _Known(numbers)
        for batch in batches:
            n = Counter(json.dumps(c) for t in texts(batch, "text") for c in swaps_in(t, known))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["change", "n"])

    data = train.mapInArrow(encode, schema).collect()  # at most ``rows`` rows of at most ``features`` numbers
    x, y = np.zeros((len(data), len(chosen)), np.float32), np.array([r.toxic for r in data], np.float32)
    for i, r in enumerate(data):
        x[i, r.present] = 1
    # different changes: two words of a list and which of their few features the sentence has otherwise, so the lists bound them
    changes = train.mapInArrow(swap, "change string, n long").groupBy("change").agg(F.sum("n").alias("n")).orderBy("change").collect()
    d, n = np.zeros((len(changes), len(chosen)), np.float32), np.array([r.n for r in changes], np.float32)
    for i, r in enumerate(changes):
        lost, gained = json.loads(r.change)
        d[i, lost], d[i, gained] = -1, 1
    w, b = _descend(x, y, d, n / max(n.sum(), 1), counterfactual, penalty)
    return {"bias": b, "weights": {f: float(v) for f, v in zip(chosen, w) if abs(v) > 1e-6}}


def _descend(x, y, d, share, counterfactual, penalty, steps: int = 400, rate: float = 0.05):
    """Adam on log loss + penalty |w|^2 / 2 + counterfactual * sum(share * change of score^2) / 2."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) / len(y)
        g = x.T @ e + penalty * w
        if len(d):
            g = g + counterfactual * (d.T @ (share * (d @ w)))
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns and ``score``: the model's probability that the text is toxic."""
    names = list(model["weights"])
    weights, bias = [model["weights"][f] for f in names], model["bias"]
    numbers = {f: i for i, f in enumerate(names)}

    def make():
        known = _Known(numbers)

        def one(t: str) -> float:
            z = bias + sum(weights[i] for i in known.present(t))
            return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

        return lambda batch: [pa.array([one(t) for t in texts(batch, text)], pa.float64())]

    return add_columns(docs, make, [T.StructField("score", T.DoubleType())], keep)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    own, names = aside(docs)
    return back(score(own, fit(docs, labels, text=text), names[text]).where(F.col("score") < threshold), names)


def op9(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
