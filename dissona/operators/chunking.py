"""Sentence windows: documents to chunks, in time proportional to a text's length.

A window depends on where the one before it ended, so texts are walked from front to back, in Arrow batches on the executors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.ids import hash_id
from dissona.runtime import ship

# Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("adm al approx apr art aug bros ca capt cf ch cl co col corp dec dept dr ed eds eg e.g est etc ex fig feb fri gen gov hon hr i.e ie inc jan jr lt ltd maj messrs mon mr mrs ms mt no nos nov oct op p para pp prof ref rep rev sec sect sen sep sept sgt sr st subsec thu tue u.k u.s viz vol vs wed".split())
BOUNDARY = re.compile(r"""([.!?])["'”’)\]]{0,3}\s++(?=\S)|\n\s*+(?=\S)""")
LAST_WORD = re.compile(r"""(?:^|[\s("'“‘\[])([^\s("'“‘\[]{1,12})\Z""")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text: a sentence ends with a mark before white space, or with its line; the white space, however long, goes with it.

    A full stop after an abbreviation or a single capital letter ends none, unless a quotation or the line ends there.
    """
    ends, whole = [], len(text.rstrip())
    for m in BOUNDARY.finditer(text, 0, whole):
        if m[1] == "." and m[0][1].isspace() and "\n" not in m[0]:
            word = LAST_WORD.search(text, max(0, m.start() - 13), m.start())
            if word and (word[1].lower() in ABBREVIATIONS or len(word[1]) == 1 and word[1].isupper()):
                continue
        ends.append(m.end())
    ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True)) if text else []


def windows(spans: list[tuple[int, int]], max_chars: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Runs of sentences of at most max_chars (one longer sentence stands alone); with overlap each begins with the tail of the one before.

    After an overlap the next sentence joins without a further test. A tail that would be the whole window is dropped.
    """
    out: list[tuple[int, int]] = []
    starts = [s for s, _ in spans]
    first = 0  # of the open window's sentences
    for i, (s, e) in enumerate(spans):
        if i > first and e - spans[first][0] > max_chars:
            out.append((spans[first][0], spans[i - 1][1]))
            tail = bisect_left(starts, spans[i - 1][1] - overlap, first, i) if overlap else i
            first = i if tail == first else tail
    if spans:
        out.append((spans[first][0], spans[-1][1]))
    return out


def _spans_of(df: DataFrame, text: Column, function) -> Column:
    """ARRAY<STRUCT<s, e>> of a text column by a function of one text."""
    ship(df.sparkSession)

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"s": s, "e": e} for s, e in function(t or "")] for t in texts.to_pylist()], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return run(text)


def sentences(df: DataFrame, text: Column) -> Column:
    """Sentence spans of a text column; none for an empty or null text."""
    return _spans_of(df, text, sentence_spans)


def chunk_documents(documents: DataFrame, *, max_chars: int = 1000, overlap_chars: int = 0) -> DataFrame:
    """chunk_id, doc_id, text, char_start, char_end of documents (doc_id, text); text is what the document has there. Empty and null texts have no chunks."""
    if max_chars < 1 or overlap_chars < 0:
        raise ValueError("max_chars is 1 or more, overlap_chars 0 or more")
    overlap = min(overlap_chars, max_chars - 1)
    rows = documents.filter("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(documents.sparkSession)
    names, kinds = ["doc_id", "text", "char_start", "char_end"], [pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for s, e in windows(sentence_spans(text), max_chars, overlap):
                    for c, v in zip(out, (doc, text[s:e], s, e), strict=True):
                        c.append(v)
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    chunks = rows.mapInArrow(run, "doc_id string, text string, char_start int, char_end int")
    return chunks.select(hash_id("doc_id", F.col("char_start").cast("string"), F.col("char_end").cast("string")).alias("chunk_id"), *names)
