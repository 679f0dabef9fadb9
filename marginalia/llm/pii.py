"""Personal data in texts: fixed patterns, and further spans that a weakly supervised classifier accepts.

Every candidate span is judged by labelers that vote 1 (private), -1 (not) or 0 (no opinion): the pattern's own checks, a
gazetteer (top-level domains, calling codes, card issuers, reserved networks, given names), the words before it, its
borders, and whether the text holds candidates of other kinds. Candidates come from the patterns, from the gazetteer (a given name
and a word in capitals) and from the context (words behind "my name is", digit groups behind "phone", in four languages). Nobody labels anything: expectation-maximisation over the
counts of (kind, votes) estimates how reliable each labeler is and how likely each combination is private. On those
estimates a logistic regression over kind, votes and length is trained, the span classifier. Base spans (email, ip, card,
phone) always stay; other candidates, among them base matches that failed their check, are added as ``likely`` from a
probability of ``THRESHOLD`` on.

The main path is DataFrame functions only: matches and the texts between them give positions, lengths being summed up in
blocks. What reaches the driver is the table of counts, at most one row for each kind, combination of votes and length
class, whatever the input.

Defined cases: a null or empty text has no spans; positions count code points; texts are searched whole; repeated rows give
repeated results; without candidates there is nothing to train and nothing to add; extra columns are kept by ``find``.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import aside, back, column
from marginalia.session import stored

BASE = ("email", "ip", "card", "phone")
EXTRA = ("ssn", "local", "iban", "spelled", "name", "given", "introduced", "dialled")
KINDS = (*BASE, *(f"bad_{k}" for k in BASE[1:]), *EXTRA)
THRESHOLD = 0.5
# The base patterns. A match may start where none of its first characters stands before, or where the last match ended;
# possessive repeats leave the matches as they are and keep the search linear. Cards are whole chains of 12 to 19 digits.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further candidates, told apart by their form.
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+])(?<!\+[0-9]{1,3}[\x20.-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.][0-9]{4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,}+"
CAPITAL = r"\p{Lu}[\p{L}'\x{2019}-]++"
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Srta)\.?|M\.|Mme|Mlle|Monsieur|Madame|Herr|Frau|Se\x{F1}or|Se\x{F1}ora|Don|Do\x{F1}a"
NAME = rf"(?<!\p{{L}})(?:{TITLES})\x20{CAPITAL}(?:\x20{CAPITAL})?"
# Gazetteers and cues.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|us|uk|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ie|ca|au|nz|jp|cn|in|br|mx|ru|za|kr"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65|64[4-9]|35|62"
RESERVED = r"(0|10|127)\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|(22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
GIVEN_NAMES = "James|John|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Anna|Maria|Peter|Paul|Thomas|Daniel|Laura|Sarah|Emma|Julia|Marie|Pierre|Hans|Carlos|Juan|Luis|Carmen"
#: What a name follows, and what a number follows, in English, German, French and Spanish.
NAMING = r"(?:name is|mein Name ist|ich hei\x{DF}e|ich heisse|je m'appelle|mon nom est|me llamo|mi nombre es)"
DIALLING = r"(?:phone|telephone|tel|telefon|telefonnummer|handy|mobil|mobile|t\x{E9}l\x{E9}phone|t\x{E9}l|portable|tel\x{E9}fono|m\x{F3}vil|cell|call|fax)"
GIVEN = rf"(?<!\p{{L}})(?:{GIVEN_NAMES})\x20{CAPITAL}"
INTRODUCED = rf"(?<=(?iu:{NAMING})\x20){CAPITAL}(?:\x20{CAPITAL}){{0,2}}"
DIALLED = rf"(?<=(?<!\p{{L}})(?iu:{DIALLING})[.:]{{0,2}}\x20)\(?[0-9](?:[\x20()./-]{{0,2}}[0-9]){{5,14}}+(?![0-9])"
FORMS = {"ssn": SSN, "local": LOCAL, "iban": IBAN, "spelled": SPELLED, "name": NAME, "given": GIVEN, "introduced": INTRODUCED, "dialled": DIALLED}
CUES = NAMING.lower() + "|" + DIALLING.lower() + r"\b|e-?mail|mail|phone|tel\b|telephone|mobile|cell|call|fax|contact|reach|card|visa|mastercard|amex|payment|account|iban|ssn|social security|address|name is|login|user|ip\b"
AGAINST = r"order|invoice|isbn|version|serial|ref\b|reference|page|section|chapter|part no|model|build|release"
LABELERS = ("check", "gazetteer", "cue", "border", "company")
BLOCK = 128


def running(sizes: Column) -> Column:
    """Running sums of an array, in blocks so that the work stays far below the square of its length."""
    n = F.size(sizes)
    cumulate = lambda xs: F.slice(F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.size(xs))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: cumulate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1))))
    joined = F.flatten(F.zip_with(blocks, F.slice(before(blocks), F.lit(1), F.size(blocks)), lambda b, s: F.transform(b, lambda x: x + s)))
    return F.when(n > 0, joined).otherwise(F.array().cast("array<int>"))


def matches(df: DataFrame, name: str, text: Column, pattern: str, when: Column) -> DataFrame:
    """Add ``name``: (m, start, end, before, after) of all matches, with 40 characters before and 20 after."""
    fold = F.split(text, pattern)
    out = df.withColumn("_m", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_g", F.when(F.size("_m") > 0, fold).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_s", running(F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: F.length(g) + F.length(m))))
    item = lambda m, i: F.struct(
        m.alias("m"), (F.get("_s", i) - F.length(m)).alias("start"), F.get("_s", i).alias("end"),
        F.lower(F.substring(F.get("_g", i), -40, 40)).alias("before"), F.substring(F.get("_g", i + 1), 1, 20).alias("after"))
    return out.withColumn(name, F.transform("_m", item)).drop("_m", "_g", "_s")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit; every second digit from the right is doubled."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _never() -> Column:
    return F.lit(False)


PARTS_OF_IP = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _judged(kind: str, x: Column) -> Column:
    """Kind, votes and length class of a match; ``company`` is known only later."""
    m, digits = x["m"], _digits(x["m"])
    good = {
        "email": lambda: F.lit(True), "ip": lambda: m.rlike(PARTS_OF_IP), "card": lambda: luhn(digits),
        "phone": lambda: F.length(digits).between(9, 15),
        "ssn": lambda: ~m.rlike("^(000|666|9)|-00-|-0000$"), "local": lambda: ~m.rlike(r"^\(?[01]"),
        "iban": lambda: F.lit(True), "spelled": lambda: F.lit(True), "name": lambda: F.lit(True),
        "given": lambda: F.lit(True), "introduced": lambda: F.lit(True), "dialled": lambda: F.lit(True),
    }[kind]()
    listed = {
        "email": lambda: _vote(F.lower(m).rlike(rf"\.({DOMAINS})$"), _never()),
        "ip": lambda: _vote(_never(), m.rlike(f"^0*({RESERVED})")),
        "card": lambda: _vote(digits.rlike(f"^({ISSUERS})"), F.lit(True)),
        "phone": lambda: _vote(digits.rlike(f"^({CALLING_CODES})"), F.lit(True)),
        "ssn": lambda: F.lit(0), "local": lambda: F.lit(0),
        "iban": lambda: _vote(m.rlike("^(DE|FR|ES|IT|NL|BE|AT|CH|GB|IE|PT|PL|SE|NO|DK|FI|LU|CZ)"), F.lit(True)),
        "spelled": lambda: _vote(F.lower(m).rlike(rf"[.\])]\x20?({DOMAINS})$"), F.lit(True)),
        "name": lambda: _vote(m.rlike(rf"\b({GIVEN_NAMES})\b"), _never()), "given": lambda: F.lit(1),
        "introduced": lambda: _vote(m.rlike(rf"\b({GIVEN_NAMES})\b"), _never()), "dialled": lambda: F.lit(0),
    }[kind]()
    name = F.when(good, kind).otherwise(f"bad_{kind}" if kind in BASE[1:] else kind)
    return F.struct(
        name.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _vote(good, F.lit(True)).alias("check"), listed.alias("gazetteer"),
        _vote(x["before"].rlike(CUES), x["before"].rlike(AGAINST)).alias("cue"),
        _vote(~x["before"].rlike(r"[\p{L}\p{N}]$") & ~x["after"].rlike(r"^[\p{L}\p{N}]"), F.lit(True)).alias("border"),
        F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int").alias("size"))


def _judge(kind: str):
    return lambda x: _judged(kind, x)


def candidates(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``candidates``: spans of all kinds with their votes."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "candidates"]
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    body = F.col("_text")
    some_digits = body.rlike("[0-9]")
    out = matches(out, "_email", body, EMAIL, F.contains(body, F.lit("@")))
    out = matches(out, "_ip", body, IP, some_digits)
    out = matches(out, "_card", body, CARD, some_digits)
    out = matches(out, "_phone", body, PHONE, F.contains(body, F.lit("+")))
    four = body.rlike("[0-9]{4}")
    once = {"ssn": four, "local": four, "iban": four, "spelled": body.rlike(r"[\[(]at[\])]"), "name": body.rlike(rf"(?:{TITLES})\x20\p{{Lu}}"),
            "given": body.rlike(rf"(?:{GIVEN_NAMES})\x20\p{{Lu}}"), "introduced": body.rlike(rf"(?iu){NAMING}\x20"),
            "dialled": some_digits & body.rlike(rf"(?iu){DIALLING}[.:]{{0,2}}\x20\(?[0-9]")}
    for kind, pattern in FORMS.items():
        out = matches(out, f"_{kind}", body, pattern, once[kind])
    groups = [F.transform(f"_{k}", _judge(k)) for k in (*BASE, *EXTRA)]
    own = out.select(*kept, F.concat(*groups).alias("_all"))
    several = F.size(F.array_distinct(F.transform("_all", lambda x: F.regexp_replace(x["kind"], "^bad_", "")))) > 1
    return own.withColumn("_company", F.when(several, 1).otherwise(0)).select(
        *kept, F.transform("_all", lambda x: x.withField("company", F.col("_company"))).alias("candidates"))


def counts(found: DataFrame) -> list:
    """How often each kind, combination of votes and length class occurs."""
    one = found.where(F.size("candidates") > 0).select(F.explode("candidates").alias("x"))
    return one.groupBy(F.col("x.kind").alias("kind"), *[F.col(f"x.{v}").alias(v) for v in LABELERS], F.col("x.size").alias("size")) \
        .agg(F.count("*").alias("n")).collect()


def reliabilities(rows: list, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, dict]:
    """Expectation-maximisation with votes independent given the class.

    Returns the probability of being private for each row, the vote tables P(vote | class) for each labeler, and the share
    of private candidates of each kind. It starts from the belief that labelers are right seven times in ten.
    """
    n = np.array([r["n"] for r in rows], float)
    votes = np.array([[r[v] + 1 for v in LABELERS] for r in rows])
    kind = np.array([KINDS.index(r["kind"]) for r in rows])
    table = np.array([[[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]] * len(LABELERS))
    prior = np.full(len(KINDS), 0.5)
    p = np.zeros(len(rows))
    for _ in range(rounds):
        log = np.log(np.stack([1 - prior[kind], prior[kind]], 1))
        for j in range(len(LABELERS)):
            log += np.log(table[j][:, votes[:, j]]).T
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
        weight = np.stack([n * (1 - p), n * p])
        for j in range(len(LABELERS)):
            for v in range(3):
                # smoothed towards the starting belief, so that a labeler cannot change sides on little evidence
                start = ([0.5, 0.3, 0.2], [0.1, 0.3, 0.6])
                for c in (0, 1):
                    table[j, c, v] = (weight[c, votes[:, j] == v].sum() + 10 * start[c][v]) / (weight[c].sum() + 10)
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (weight[1, own].sum() + 1) / (n[own].sum() + 2)
    return p, table, dict(zip(KINDS, prior))


def features() -> list[tuple[str, object]]:
    return [*(("kind", k) for k in KINDS), *product(LABELERS, (-1, 1)), *(("size", s) for s in range(4))]


def train(rows: list, penalty: float = 1.0, steps: int = 60) -> dict:
    """The span classifier: weights of a logistic regression on the estimated probabilities, by Newton's method."""
    names = features()
    if not rows:
        return {"bias": -10.0, "weights": {f: 0.0 for f in names}}
    p, _, _ = reliabilities(rows)
    n = np.array([r["n"] for r in rows], float)
    x = np.array([[1.0] + [float(r[f] == v) for f, v in names] for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - p)) + penalty * w
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return {"bias": float(w[0]), "weights": dict(zip(names, w[1:].tolist()))}


def probability(x: Column, model: dict) -> Column:
    score = F.lit(model["bias"])
    for f in ("kind", *LABELERS, "size"):
        own = [(v, w) for (g, v), w in model["weights"].items() if g == f]
        part = F.when(x[f] == own[0][0], F.lit(own[0][1]))
        for v, w in own[1:]:
            part = part.when(x[f] == v, F.lit(w))
        score = score + part.otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def find(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``found``: spans (start, rank of kind, kind, end, probability), sorted by start and kind."""
    own, names = aside(docs.select(*[column(c) for c in dict.fromkeys([*(docs.columns if keep is None else keep), text])]))
    kept = {c: names[c] for c in (docs.columns if keep is None else keep) if c != "found"}
    judged = stored(candidates(own, names[text], list(kept.values())), "pii")
    model = train(counts(judged))
    listed = {k: i for i, k in enumerate(BASE)}
    rank = lambda k: F.coalesce(*[F.when(k == b, i) for b, i in listed.items()], F.lit(len(BASE)))
    scored = F.transform("candidates", lambda x: F.struct(
        x["start"].alias("start"), rank(x["kind"]).alias("rank"), F.when(x["kind"].isin(*BASE), x["kind"]).otherwise("likely").alias("kind"),
        x["end"].alias("end"), probability(x, model).alias("probability")))
    found = F.filter(scored, lambda x: (x["kind"] != "likely") | (x["probability"] >= threshold))
    # a span that several proposers found is one
    ordered = F.flatten(F.transform(F.array(F.array_sort(found)), lambda xs: F.filter(xs, lambda x, i: (x["kind"] != "likely") | (i == 0) | ~(
        (F.get(xs, i - 1)["kind"] == "likely") & (F.get(xs, i - 1)["start"] == x["start"]) & (F.get(xs, i - 1)["end"] == x["end"])))))
    return back(judged, kept, ordered.alias("found"))


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, keep=["doc_id"])
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] != "likely")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("found")).alias("spans"), of("likely").alias("n_likely"))
