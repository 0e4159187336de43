"""PDF and DOCX files as elements, with an optional OCR step for files that hold hardly any text.

A file is parsed in one task: DOCX through its XML, PDF through its page content streams (plain or deflated), its fonts' maps to
Unicode and its compressed objects; an encrypted file is one that can't be parsed. Other parsers and an OCR engine plug in as
functions from bytes to elements.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.functions.text import needs_ocr
from dissona.operators.store import element_text
from dissona.runtime import durable, ship

Elements = list[tuple[str, str]]
Parser = Callable[[bytes], Elements]
# Kinds of elements that are body text.
BODY = ("NarrativeText", "Title", "ListItem", "Text", "Table", "UncategorizedText")
SCHEMA = "path string, length long, pages int, status string, idx int, kind string, text string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(content: bytes) -> Elements:
    """Paragraphs (titles by their style) and tables, a table's cells apart by spaces, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out: Elements = []
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and style.get(f"{_W}val", "").lower().startswith(("heading", "title"))
            out.append(("Title" if heading else "NarrativeText", text(node)))
        elif node.tag == f"{_W}tbl":
            out.append(("Table", " ".join(text(c).strip() for c in node.iter(f"{_W}tc"))))
    return out


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?=\bendobj\b)", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|')|(T\*|\bT[dDm]\b|\bET\b)|/([^\s/<>\[\]()]+)\s+[-0-9.]+\s+Tf\b", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
Codes = dict[bytes, str]


def _objects(content: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """Number, dictionary and decoded stream (None without one) of a file's objects, those in compressed object streams too."""
    if b"/Encrypt" in content:
        raise ValueError("an encrypted file")
    for number, body in _OBJECT.findall(content):
        found = _STREAM.search(body)
        head, data = (body[: found.start()], found[1]) if found else (body, None)
        if data is not None and b"/FlateDecode" in head:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                data = b""
        yield int(number), head, data
        first = re.search(rb"/First\s+(\d+)", head)
        if data and first and re.search(rb"/Type\s*/ObjStm", head):
            index = [int(x) for x in data[: int(first[1])].split()]
            starts = [*index[1::2], len(data)]
            for n, s, e in zip(index[::2], starts, starts[1:], strict=False):
                yield n, data[int(first[1]) + s : int(first[1]) + e], None


def _codes(cmap: bytes) -> Codes:
    """What a font's codes stand for, from its ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: Codes = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, first, last, base = len(a) // 2, int(a, 16), int(b, 16), text(to)
            out |= {k.to_bytes(width, "big"): base[:-1] + chr(ord(base[-1]) + k - first) for k in range(first, min(last, first + 0xFFFF) + 1)}
    return out


def _shown(string: tuple[bytes, bytes], codes: Codes | None) -> str:
    """A literal or hexadecimal string of a content stream, in the codes of its font."""
    literal, digits = string
    digits = re.sub(rb"\s", b"", digits)
    raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()) if digits else _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), literal)
    if not codes:
        return raw.decode("cp1252", "replace")
    width = max(map(len, codes))
    return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def pdf_elements(content: bytes) -> Elements:
    """Lines of the content streams; a move of the text position ends a line. Fonts with a ToUnicode map are read through it, others as Western single bytes."""
    objects = list(_objects(content))
    streams = {n: data for n, _, data in objects if data}
    maps = {n: int(m[1]) for n, head, _ in objects if (m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", head))}
    fonts = {name: _codes(streams.get(maps[int(n)], b"")) for _, head, _ in objects for x in re.findall(rb"/Font\s*<<(.*?)>>", head, re.S) for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", x) if int(n) in maps}
    out: Elements = []
    for data in streams.values():
        if b"BT" not in data or b"begincmap" in data:
            continue
        line, codes = "", None
        for several, single, move, font in _SHOW.findall(data):
            if font:
                codes = fonts.get(font)
            elif move:
                if line.strip():
                    out.append(("NarrativeText", line))
                line = ""
            else:
                line += "".join(_shown(x, codes) for x in _STRING.findall(several or single))
        if line.strip():
            out.append(("NarrativeText", line))
    return out


def pdf_pages(content: bytes) -> int:
    """Pages of a PDF, 0 where that can't be read."""
    if content[:5] != b"%PDF-":
        return 0
    try:
        return sum(len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", head)) for _, head, _ in _objects(content))
    except ValueError:
        return 0


PARSERS: dict[str, Parser] = {".docx": docx_elements, ".pdf": pdf_elements}


def parsed(files: DataFrame, parser: Parser, paged: bool) -> DataFrame:
    """SCHEMA, a row per element; a file without any has one with a null index. A file that can't be parsed has status parse_error."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, length, content in zip(b["path"], b["length"], b["content"], strict=True):
                pages = pdf_pages(content) if paged else 1
                try:
                    found, status = parser(content), "ok"
                except Exception:  # whatever a broken file raises, it is that file's state
                    found, status = [], "parse_error"
                rows += [(path, length, pages, status, i, k, t) for i, (k, t) in enumerate(found)] or [(path, length, pages, status, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "length", "pages", "status", "idx", "kind", "text"]).astype({"idx": "Int32"})

    return files.select("path", "length", "content").mapInPandas(run, SCHEMA)


def body_text(elements: DataFrame) -> DataFrame:
    """path, text, spans ARRAY<STRUCT<idx, kind, char_start, char_end>>: body elements that aren't junk, apart by blank lines."""
    placed = element_text(elements.filter(F.col("kind").isin(*BODY)).withColumnRenamed("path", "doc_id"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "kind", "char_start", "char_end", "text")))  # a file's elements: bounded by the file
    g = placed.groupBy(F.col("doc_id").alias("path")).agg(parts.alias("parts"))
    return g.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), F.transform("parts", lambda p: F.struct(p["idx"].alias("idx"), p["kind"].alias("kind"), p["char_start"].alias("char_start"), p["char_end"].alias("char_end"))).alias("spans"))


def load_elements(files: DataFrame, kind: str, ocr: Parser | None = None) -> DataFrame:
    """path, text, spans, status of PDF or DOCX files.

    Files that need OCR and for which there is an engine are read again by it: escalated if that gave enough text, ocr_failed if
    not, ocr_error if it raised; the first text stays in the latter two. Without an engine they are ok.
    """
    first = durable(parsed(files, PARSERS[kind], kind == ".pdf"))
    files_ = first.groupBy("path").agg(F.first("length").alias("length"), F.first("pages").alias("pages"), F.first("status").alias("status"))
    plain = files_.join(body_text(first), "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
    if ocr is None or kind != ".pdf":
        return plain.select("path", "text", "spans", "status")
    plain = durable(plain)
    poor = plain.filter(needs_ocr("text", "pages", "length")).select("path")
    second = durable(parsed(files.join(poor, "path", "left_semi"), ocr, True))
    again = second.groupBy("path").agg(F.first("status").alias("s2")).join(body_text(second).select("path", F.col("text").alias("t2"), F.col("spans").alias("p2")), "path", "left")
    x = plain.join(again, "path", "left")
    status = F.when(F.col("s2").isNull(), F.col("status")).when(F.col("s2") != "ok", "ocr_error").when(needs_ocr(F.coalesce("t2", F.lit("")), "pages", "length"), "ocr_failed").otherwise("escalated")
    took = status == "escalated"
    return x.select("path", F.when(took, F.col("t2")).otherwise(F.col("text")).alias("text"), F.when(took, F.col("p2")).otherwise(F.col("spans")).alias("spans"), status.alias("status"))


def ocr_events(loaded: DataFrame) -> DataFrame:
    """status, n of what OCR did."""
    return loaded.filter("status in ('escalated', 'ocr_error', 'ocr_failed')").groupBy("status").agg(F.count("*").alias("n"))


def ocr_records(loaded: DataFrame) -> DataFrame:
    """ts, event, path of each file that OCR was tried on: rows for sinks.append_json."""
    tried = loaded.filter("status in ('escalated', 'ocr_error', 'ocr_failed')")
    return tried.select(F.current_timestamp().alias("ts"), F.col("status").alias("event"), "path")


def loader(kind: str, ocr: Parser | None = None) -> Callable[[DataFrame], DataFrame]:
    """For the loader registry: path, title, text."""

    def load(files: DataFrame) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        return load_elements(files, kind, ocr).select("path", F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"), "text")

    return load
