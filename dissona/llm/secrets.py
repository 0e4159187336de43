"""Secret scans: multipart credential linking.

Base kinds (assign, access, hex) are found in every text. Beyond them, *weak* candidates are collected: access identifiers
without a telling form (`ident`), bare strings of 20 characters or more that look random (`blob`) and endpoints (`endpoint`). A weak candidate alone says
nothing; it is reported only when complementary parts of one credential co-occur. Candidates are intervals; a scope is a
paragraph (text between blank lines). Each candidate is joined to the scope whose interval contains its start by binary search,
and to its scope's complementary parts however far away they stand (`reach` can bound the distance in characters).

Defined cases: null text is empty (no spans); a null doc_id stays null; repeated rows give repeated results; an empty table gives
an empty result; other columns are ignored; texts are processed whole, in time proportional to their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, map_rows, replaced

KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the first 24 characters of a run start its match, so this finds the same runs as + with a length test
IDENT = re.compile(r"""(?<![A-Za-z0-9])(?:client_?id|user(?:_?name)?|login|access_key(?:_id)?|account(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
BLOB = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}|(?<![A-Za-z0-9])(?:host|endpoint|server|region|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{2,}""", re.I | re.A)
BREAK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds, sorted."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random_looking(s: str) -> bool:
    """Letters of both cases, digits, and over 4 bits a character."""
    counts = Counter(s)
    return bool(re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s)) and -sum(c / len(s) * math.log2(c / len(s)) for c in counts.values()) > 4.0


def weak_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that overlap no base span."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]

    def free(spans: list[tuple[int, int, int]], of: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        starts, ends = sorted(s for s, _, _ in of), sorted(e for _, _, e in of)
        return [x for x in spans if bisect_left(starts, x[2]) == bisect_right(ends, x[0])]  # as many begin before its end as end by its start

    blobs = [(m.start(), 4, m.end()) for m in BLOB.finditer(text) if _random_looking(m[0])]
    return sorted(free(found + free(blobs, found), taken))  # the value of an identifier isn't its secret, nor is a part of an address


def link(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], reach: int | None) -> list[tuple[int, int, int]]:
    """The weak candidates whose complementary parts are in their scope, within reach if that is given.

    identifier: access or ident; secret: assign, hex or blob; endpoint. An identifier needs a secret, a bare string needs an
    identifier, an endpoint needs both.
    """
    edges = [m.end() for m in BREAK.finditer(text)]
    scope = lambda x: bisect_right(edges, x[0])
    parts: dict[tuple[int, str], list[int]] = {}
    for x in sorted(base + weak):
        role = {0: "secret", 1: "ident", 2: "secret", 3: "ident", 4: "secret"}.get(x[1])
        if role:
            parts.setdefault((scope(x), role), []).append(x[0])

    def near(x: tuple[int, int, int], role: str) -> bool:
        at = parts.get((scope(x), role), [])
        if reach is None:
            return bool(at)
        i = bisect_left(at, x[0] - reach)
        return i < len(at) and at[i] <= x[2] + reach

    need = {3: ("secret",), 4: ("ident",), 5: ("ident", "secret")}
    return [x for x in weak if all(near(x, role) for role in need[x[1]])]


def scan_text(text: str | None, reach: int | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the linked weak ones."""
    text = text or ""
    base = base_spans(text)
    if not base:
        weak = weak_spans(text, base) if "=" in text or ":" in text else []  # a bare string needs an identifier, and that has = or :
    else:
        weak = weak_spans(text, base)
    return base, link(text, base, weak, reach) if weak else []


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", reach: int | None = None) -> DataFrame:
    """One row per document: doc_id, and spans ARRAY<STRUCT<kind, start, end, base>> by start, then kind; code points, end exclusive. No shuffle."""

    def run(columns: list[list]) -> list[list]:
        out = []
        for text in columns[1]:
            base, more = scan_text(text, reach)
            out.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in sorted(base + more)])
        return [columns[0], out]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    return map_rows(id_and_text(docs, id_column, text_column), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", [pa.int64(), kind])


def redact_text(text: str | None, reach: int | None = None) -> str | None:
    """The text with each span replaced by <secret>; overlapping spans go as one."""
    if text is None:
        return None
    base, more = scan_text(text, reach)
    out, at = [], 0
    for s, _, e in sorted(base + more):
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with each span of the text replaced by <secret>, and the text's length in code points set where that column is there. No shuffle."""
    at, length = docs.columns.index(text_column), docs.columns.index(length_column) if length_column in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact_text(t) for t in batch.column(at).to_pylist()]
        batch = replaced(batch, at, pa.array(texts, pa.string()))
        return batch if length is None else replaced(batch, length, pa.array([None if t is None else len(t) for t in texts], pa.int64()))

    return map_batches(docs, run)


def digest(spans: DataFrame) -> DataFrame:
    """The columns of op5 from scan_secrets()'s spans."""
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(line(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
