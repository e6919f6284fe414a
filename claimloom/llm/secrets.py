"""Secret scans by multipart credential linking.

Strong findings stand alone: assignments of passwords, tokens and keys, cloud
access identifiers, long hex runs. Besides them a text has parts that mean
little alone: login names, endpoints, and mixed-case random-looking tokens.
A weak part is reported only if a part that completes a credential lies in the
same scope, a run of lines without an empty line, however far away. That is an
interval join of secrets with identifiers and
endpoints; as a scope never leaves its document, each document's intervals are
sorted and swept where the text already is, so neither texts nor parts are
shuffled and no pair is ever built: the sweep asks for the nearest interval on
either side.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from claimloom.llm.arrow import map_columns
from claimloom.sources.tables import table

#: The strong kinds, in the order that breaks ties of position, then the weak ones.
KINDS = ("assign", "access", "hex", "token", "login", "endpoint")
BASE = KINDS[:3]
#: What a weak token needs: its length and the bits a character of its empirical entropy.
TOKEN_LENGTH, TOKEN_BITS = 20, 3.4

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOGIN = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE | re.ASCII)
_LOGIN_WORDS = ("user", "login", "client", "account")
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>|]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""", re.IGNORECASE | re.ASCII)
_ENDPOINT_WORDS = ("://", "host", "endpoint", "server")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{TOKEN_LENGTH},}}")
_SCOPE_END = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The strong findings, by start and then by kind."""
    low, found = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return _ordered(found)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _random_looking(word: str) -> bool:
    if not (any(map(str.islower, word)) and any(map(str.isupper, word)) and any(map(str.isdigit, word))):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= TOKEN_BITS


class _Near:
    """Sorted intervals that don't overlap much; tells whether one touches a stretch."""

    def __init__(self, spans: list[Span]):
        spans = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in spans]
        self.ends, most = [], 0
        for _, e in spans:
            most = max(most, e)
            self.ends.append(most)  # the furthest end so far, so that bisection works

    def touches(self, lo: int, hi: int) -> bool:
        """Is there an interval that begins before `hi` and ends after `lo`?"""
        i = bisect_left(self.starts, hi)
        return i > 0 and self.ends[i - 1] > lo


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak tokens, logins and endpoints that complete a credential with another part of their scope."""
    low = text.lower()
    logins = [("login", m.start(), m.end()) for m in _LOGIN.finditer(text)] if any(w in low for w in _LOGIN_WORDS) else []
    endpoints = [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)] if any(w in low for w in _ENDPOINT_WORDS) else []
    identifiers = [s for s in base if s[0] == "access"] + logins
    if not identifiers and not endpoints:
        return []
    taken = _Near([*base, *logins, *endpoints])
    tokens = [("token", m.start(), m.end()) for m in _TOKEN.finditer(text) if not taken.touches(m.start(), m.end()) and _random_looking(m[0])]
    secrets = [s for s in base if s[0] != "access"] + tokens
    if not secrets:
        return []
    breaks = [m.start() for m in _SCOPE_END.finditer(text)]

    def near(span: Span, others: _Near) -> bool:
        at = bisect_right(breaks, span[1])
        begin, end = (breaks[at - 1] if at else 0), (breaks[at] if at < len(breaks) else len(text))
        return others.touches(begin, end)

    who, where, what = _Near(identifiers), _Near(endpoints), _Near(secrets)
    found = [t for t in tokens if near(t, who) or near(t, where)]
    found += [x for x in logins + endpoints if near(x, what)]
    return found


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), both ordered; offsets are code points, ends exclusive."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, _ordered(base + linked_spans(text, base))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base and spans: arrays of (kind, start, end)) for every row of `docs`.

    Null and empty texts have empty arrays. Repeated rows repeat. A null id is
    kept. Very long texts are searched whole. Empty table: empty result. Other
    columns are not read. An id column named base or spans is returned as
    base_id or spans_id. Equal starts are ordered as in `KINDS`.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    kind = dict(rows.dtypes)["__id"]
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(batches):
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            found = [spans_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in found], part), pa.array([as_rows(a) for _, a in found], part)], ["__id", "base", "spans"])

    one = "array<struct<kind:string,start:long,end:long>>"
    found = map_columns(rows, step, f"__id {kind}, base {one}, spans {one}")
    return found.select(F.col("__id").alias(id_col if id_col.lower() not in ("base", "spans") else f"{id_col}_id"), "base", "spans")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every span of `text_col` replaced by its kind in angle brackets.

    Overlapping spans are replaced together, under the first one's kind. All
    rows stay; texts without a span, null ones too, stay as they are. Where
    `length_col` exists and holds integers it is set to the new length of the
    changed texts; a column of that name and another type stays as it is.
    Repeated rows repeat, an empty table stays empty, very long texts are
    searched whole.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None
    if length is not None and not isinstance(docs.schema[length].dataType, IntegralType):
        length = None

    def step(batches):
        for batch in batches:
            columns = list(batch.columns)
            old = columns[at].to_pylist()
            new = [redacted(t) for t in old]
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                sizes = columns[length].to_pylist()
                columns[length] = pa.array([n if a is b else len(b) for a, b, n in zip(old, new, sizes, strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(step, StructType(docs.schema.fields))


def redacted(text: str | None) -> str | None:
    spans = spans_of(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document: counts, a digest of the strong spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = (*BASE, *KINDS[3:])

    def step(batches):
        write = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            found = [spans_of(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in a) for _, a in found], pa.int64()) for k in kinds]
            digests = pa.array([hashlib.sha256(write(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([write(a) for _, a in found], pa.string())], ["doc_id", *[f"n_{k}" for k in kinds], "base_sha256", "spans"])

    named = ", ".join(f"n_{k} long" for k in kinds)
    found = map_columns(docs, step, f"doc_id {dict(docs.dtypes)['doc_id']}, {named}, base_sha256 string, spans string")
    return found.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", *[f"n_{k}" for k in KINDS[3:]])


def op1_secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of the base kinds every document has."""
    return op1_secrets(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE])


BASE_ORACLE = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM documents
"""
