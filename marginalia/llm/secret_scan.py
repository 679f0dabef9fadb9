"""Secrets in texts: fixed patterns, and values in a credential's place that would take many guesses.

Base kinds are ``assign`` (a keyword, a sign and a value), ``access`` (key ids) and ``hex`` (long runs). The method adds
``guess``: the values alone, after a wider set of credential words and whatever characters they hold, whose cheapest
segmentation (guesses.py) costs at least ``least`` (log10). Guessable values such as "changeme" are not reported by it, and at
the default no value of fewer than eight characters can be: eight that nothing explains cost 8.3, seven 7.3.
A value has any length: a quoted one ends at its closing quote, or at the line end, a key block at its end line.
Base spans stay.

Defined cases: a null or empty text has no spans; positions count code points; all text is scanned; repeated rows
give repeated results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import add_columns, texts
from marginalia.llm.guesses import log10_guesses

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What stands between quotes up to the closing one, or the line end where none follows; a backslash takes the next character with it.
_QUOTED = "|".join(rf"""{q}(?:SCHEME\x20+)?(?=(?:[^{q}\\\n]|\\[^\n]?){{6}}|[^{q}\n]{{6}})((?:[^{q}\\\n]|\\[^\n]?)++)""" for q in "\"'")
#: A credential word, a sign and a value. A key block goes to its end line; a word that names a scheme is no value. Behind
#: "bearer" a blank is sign enough where the value holds a digit or 20 characters, as words of prose do not.
CONTEXT = re.compile((
    r"""(?<![A-Za-z0-9])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization|bearer"""
    r"""|(?:api|access|auth|private|client|secret)[_\x20-]?(?:key|secret|token))["']?"""
    r"""(?:\x20*(?:=>|:=|[:=])\x20*|\x20is\x20)|bearer\x20+(?=["']?(?:[^\s"'<>0-9]*+[0-9]|[^\s"'<>]{20})))"""
    r"""(?:["']?(-----BEGIN[A-Z0-9\x20]*+-----(?:[^-]|-(?!----))*+-----END[A-Z0-9\x20]*+-----)"""
    rf"""|{_QUOTED}|(?:SCHEME\x20+)?([^\s"'<>]{{6,}}))""").replace("SCHEME", "(?:bearer|basic|digest|negotiate|ntlm|token|apikey)"), re.I | re.A)
#: Without one of these no credential word is there.
ASSIGN_WORDS, CONTEXT_WORDS = ("password", "passwd", "secret", "token", "api"), ("pass", "pwd", "secret", "token", "cred", "auth", "bearer", "key")
#: log10 of the guesses from which a value counts as a secret.
LEAST = 8.0
MASK = "[secret]"


def find(text: str, least: float = LEAST) -> list[tuple[int, int, int, int]]:
    """(start, number of kind, end, start of the value), sorted."""
    lower = text.lower()
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    if any(w in lower for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if log10_guesses(text[start:end]) >= least:
                out.append((start, 3, end, start))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def scan(docs: DataFrame, text: str = "text", least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """All columns and ``found``: spans (kind, start, end, value_start, log10_guesses), in order of start and kind."""
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("value_start", T.LongType()), T.StructField("log10_guesses", T.DoubleType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()),
                               ("log10_guesses", pa.float64())]))

    def make():
        def compute(batch):
            return [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "value_start": v, "log10_guesses": log10_guesses(t[v:e])}
                               for s, k, e, v in find(t, least)] for t in texts(batch, text)], kind)]

        return compute

    return add_columns(docs, make, [T.StructField("found", T.ArrayType(item))], keep)


def masked(text: str, least: float = LEAST, mask: str = MASK) -> str:
    """The text with every secret value replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, _, end, value in find(text, least)):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """The same columns; secret values in the text are replaced. A null text stays null."""
    def make():
        return lambda batch: [pa.array([t if t is None else masked(t, least) for t in batch.column(text).to_pylist()], pa.string())]

    return add_columns(docs, make, [docs.schema[text]]).select(*docs.columns)


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, keep=["doc_id"])
    of = lambda kinds: F.expr(f"filter(found, x -> x.kind in ({kinds}))")
    line = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *(F.size(of(f"'{k}'")).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(line(of("'assign','access','hex'")), 256).alias("base_sha256"), line(F.col("found")).alias("spans"),
        F.size(of("'guess'")).cast("long").alias("n_guess"),
        F.array_max(F.transform("found", lambda x: x["log10_guesses"])).alias("hardest"))
