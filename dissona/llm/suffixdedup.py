"""Repeated byte strings: every byte that a string of `length` bytes covers which also starts elsewhere is removed.

All suffixes of a corpus are too many to exchange, so sorting is kept for the few whose place decides something:

1. Anchors. The leftmost least hash of the k-grams in a window of `length` bytes is a function of its content, so equal windows
   have equal anchors at equal offsets. Windows next to each other with one anchor are a segment. Where an anchor's k-gram is
   found once in the corpus, none of its windows is repeated: nine tenths of all segments end here.
2. Blocks. What is left is cut into blocks of offsets from the anchor. If the union of a block's windows is found elsewhere, all its
   windows are repeated; if their intersection isn't, none is. Only blocks that an edge of a repeat crosses stay open.
3. Suffixes. The windows of open blocks are suffixes that share a known prefix: the intersection, whose name (a hash) stands for
   it. Each task sorts its suffixes and writes front-coded runs (bytes shared with the one before, and the rest); ranges of them
   are exchanged, and each is merged with a loser tree that keeps, for each run's head, the prefix it shares with the last winner,
   and compares only bytes beyond it (`runs`). Suffixes next to each other that share all bytes are repeats.

Each step asks of a key only whether it has two distinct places, by least and greatest place, which combines before a shuffle: no
group of copies meets in one task. Of segments and blocks with one content, one goes on as partner of the others. Identical texts
are one text; if there are two, all of it is repeated. Strings are compared by 128-bit hashes of their bytes (steps 1 and 2).

Passages: apart from what is removed, each string of PASSAGE words that another document holds too counts, however many bytes it has.
Anchors and blocks again, this time of words, leave the strings whose anchor and whose block's common words are in two texts; those
are looked up by 64-bit hashes. A word is what stands between white space (ASCII), so passages that differ in white space alone are
equal; repeats within one document don't count. Nothing is removed for a passage.

Texts are dealt out once, each text once from each task: they go to a table bucketed by the hash of the text. What a later step has
to look up in them is dealt by the same hash, so its joins move no text, whatever the size; nothing is broadcast. Places are named
by the text's hash, so a text that comes from several tasks is still at one place.

Defined cases: a null text is empty; a null doc_id stays null; repeated rows repeat each other; texts shorter than `length` lose
nothing; an empty table gives an empty result; other columns are ignored; a long text is cut into overlapping stretches for the
anchors, so memory is bounded but for the text itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.runtime import bucketed, durable, ship, stored

from .runs import equal_places

LENGTH, GRAM, BLOCK, STRETCH, SEEN = 400, 48, 16, 1 << 22, 1_000_000
PASSAGE, WORDS = 51, 8  # over 50 words; an anchor's words
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.array([0 if _SPACE.match(bytes([i])) else 1 for i in range(256)], np.int8)
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size][0][:n], _powers[size][1][:n]


def gram_hashes(a: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A mixed rolling hash of each k-gram of bytes."""
    up, down = _power(len(a))
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[a] * up, out=total[1:])
    h = total[k:] - total[:-k]
    h *= down[: len(h)]
    return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: bytes, stretch: int = STRETCH) -> np.ndarray:
    """A hash of each word, a stretch at a time."""
    parts, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + stretch) if at + stretch < len(data) else None
        end = cut.start() if cut else len(data)
        a = np.frombuffer(data, np.uint8)[at:end]
        edges = np.flatnonzero(np.diff(_IN_WORD[a], prepend=np.int8(0), append=np.int8(0)))
        parts.append(_Strings(_TABLE[a])(edges[::2], edges[1::2]))
        at = end
    return np.concatenate(parts)


class _Strings:
    """Hashes of strings of a sequence, by running sums."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _power(len(values) + 1)
        self.total = np.empty(len(values) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(values * up[:-1], out=self.total[1:])

    def __call__(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[first]) * self.down[first])

    def grams(self, k: int) -> np.ndarray:
        return _mixed((self.total[k:] - self.total[:-k]) * self.down[: len(self.total) - k])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks in both directions."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    right = np.minimum.accumulate(y, 1).ravel()
    left = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays anchor, its k-gram's hash, first window, end of windows: for a stretch of windows at a time."""
    yield from _segments(np.frombuffer(data, np.uint8), gram_hashes, length, gram, stretch)


def _segments(a: np.ndarray, hashes: Callable[[np.ndarray, int], np.ndarray], length: int, gram: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    bits = (stretch + length).bit_length()
    low = np.uint64((1 << bits) - 1)
    for at in range(0, len(a) - length + 1, stretch):
        h = hashes(a[at : at + stretch + length - 1], gram)
        least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        anchor = (least & low).astype(np.int64)
        edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
        first = edges[:-1]
        yield anchor[first] + at, h[anchor[first]].view(np.int64), first + at, edges[1:] + at


def _digest(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(data)


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _shared(blocks: DataFrame) -> DataFrame:
    """The blocks whose core is at two places."""
    cores = blocks.groupBy("core").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("core")
    return blocks.join(durable(cores), "core", "left_semi")  # both sides dealt out plainly, so that a hot core can be split


def _settle(blocks: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """blocks: core, full, place and payload. Gives those with full at two places, and one of each full whose core has an open block and another full.

    Hot cores and fulls are combined before the shuffles; the joins back can be split.
    """
    classes = durable(blocks.groupBy("core", "full").agg(F.max("place").alias("b"), F.min(F.struct("place", *payload)).alias("one")))
    once = F.col("one.place") == F.col("b")
    cores = durable(classes.groupBy("core").agg(F.count("*").alias("n"), F.max(once).alias("open")).filter("n > 1 and open").select("core"))
    twice = classes.filter(~once).select("full")
    left = classes.join(cores, "core", "left_semi").select("one.*", "core")
    return blocks.join(twice, "full", "left_semi").select("key", "first", "end"), left.select("key", "anchor", "first", "end", "core")


def repeated_windows(texts: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """texts (key BINARY, data BINARY; equal keys have equal data): key, first, end of windows that start at another place too."""
    ship(texts.sparkSession)
    b16, i64 = pa.binary(), pa.int64()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(data := data.as_py()) < length:
                    continue
                for anchor, h, first, end in segments(data, length, gram):
                    full = [_digest(data[s : e + length - 1]) for s, e in zip(first.tolist(), end.tolist(), strict=True)]
                    yield _batch(["core", "full", "key", "anchor", "first", "end"], [i64, b16, b16, i64, i64, i64], [h, full, [key] * len(h), anchor, first, end])

    place = F.xxhash64("key", "anchor")
    found = texts.mapInArrow(anchors, "core long, full binary, key binary, anchor long, first long, end long").withColumn("place", place)
    with stored(found) as every:
        found = durable(_shared(every))
    whole, left = _settle(found, ["key", "anchor", "first", "end"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each segment: for each block of offsets, the window starts in it, the intersection and, where it lies within the text, the union, each with the block's number."""
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for key, data, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                for p in parts:
                    a = p["anchor"]
                    for q in range((a - p["end"] + 1) // block, (a - p["first"]) // block + 1):
                        s, e = a - q * block - block + 1, a - q * block  # of the block's windows the first and last start
                        full = _digest(data[s : e + length] + q.to_bytes(4, "little", signed=True)) if s >= 0 and e + length <= len(data) else None
                        core = int.from_bytes(_digest(data[max(e, 0) : s + length] + q.to_bytes(4, "little", signed=True))[:8], "little", signed=True)
                        for c, v in zip(rows, (core, full, key, a, max(s, p["first"]), min(e + 1, p["end"]), s), strict=True):
                            c.append(v)
            yield _batch(["core", "full", "key", "anchor", "first", "end", "start"], [i64, b16, b16, i64, i64, i64, i64], rows)

    joined = texts.join(left.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "end")).alias("parts")), "key")
    cut = joined.select("key", "data", "parts").mapInArrow(blocks, "core long, full binary, key binary, anchor long, first long, end long, start long")
    cut = cut.withColumn("full", F.coalesce("full", F.concat("key", F.encode(F.col("start").cast("string"), "UTF-8")))).withColumn("place", F.xxhash64("key", "start"))
    with stored(cut) as every:
        whole2, left2 = _settle(durable(_shared(every)), ["key", "anchor", "first", "end"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, int]]:
        """Compact suffixes of open blocks: the name of the bytes all share, the offset, and the bytes on both sides of them."""
        for batch in batches:
            for key, data, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                for p in parts:
                    q = (p["anchor"] - p["first"]) // block
                    s, e = p["anchor"] - q * block - block + 1, p["anchor"] - q * block
                    core = p["core"].to_bytes(8, "big", signed=True)
                    for w in range(p["first"], p["end"]):
                        yield core + bytes([w - s]) + data[w : max(e, 0)] + data[s + length : w + length], key, w

    open_ = texts.join(left2.groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "end", "core")).alias("parts")), "key")
    single = equal_places(open_.select("key", "data", "parts"), suffixes, durable)
    spans = whole.select("key", "first", "end").unionByName(whole2.select("key", "first", "end"))
    return spans.unionByName(single.select("key", "first", (F.col("first") + 1).alias("end")))


def shared_passages(texts: DataFrame, *, passage: int = PASSAGE, gram: int = WORDS, block: int = BLOCK, stretch: int = STRETCH >> 4) -> DataFrame:
    """texts (key BINARY, data BINARY; equal keys have equal data): key, passages, the first words of the strings of `passage` words that are in another text too."""
    ship(texts.sparkSession)
    block, i64 = min(block, passage), pa.int64()

    def anchored(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Strings, int]]:
        words = word_hashes(data) if len(data) >= 2 * passage - 1 else np.empty(0, np.uint64)
        for at in range(0, len(words) - passage + 1, stretch):
            here = _Strings(words[at : at + stretch + passage - 1])
            for anchor, h, first, end in _segments(here.grams(gram), lambda x, _: x.copy(), passage - gram + 1, 1, stretch):
                yield anchor, h, first, end, here, at

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, h, *_ in anchored(data.as_py()):
                    cores.append(np.unique(h))
                    places.append(np.full(len(cores[-1]), place, np.int64))
            yield _batch(["core", "place"], [i64, i64], [np.concatenate(cores), np.concatenate(places)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where an anchor is in two texts: for each block of offsets, the words that all its strings share, the first string and the hashes of all."""
        for batch in batches:
            for place, data, cores in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = cores.values.to_numpy(zero_copy_only=False)
                for anchor, h, first, end, here, at in anchored(data.as_py()):
                    kept = np.isin(h, found)
                    if not kept.any():
                        continue
                    a, first, end = anchor[kept], first[kept], end[kept]
                    low, n = (a - end + 1) // block, (a - first) // block - (a - end + 1) // block + 1
                    a, first, end = np.repeat(a, n), np.repeat(first, n), np.repeat(end, n)
                    q = np.repeat(low, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                    e = a - q * block
                    core = here(e, e - block + 1 + passage) ^ q.astype(np.uint64)
                    s, e = np.maximum(e - block + 1, first), np.minimum(e + 1, end)
                    w = np.concatenate([np.empty(0, np.int64), *map(np.arange, s, e)])
                    strings = pa.ListArray.from_arrays(np.r_[0, np.cumsum(e - s)].astype(np.int32), pa.array(here(w, w + passage).view(np.int64)))
                    yield _batch(["core", "place", "first", "strings"], [i64, i64, i64, pa.list_(i64)], [core.view(np.int64), np.full(len(a), place, np.int64), s + at, strings])

    place = F.xxhash64("key").alias("place")
    keys = texts.select(place, "key").distinct()
    with stored(texts.select(place, "data").mapInArrow(anchors, "core long, place long")) as every:
        left = durable(_shared(every).groupBy("place").agg(F.collect_set("core").alias("cores")).join(keys, "place").select("key", "cores"))
    with stored(texts.join(left, "key").select(place, "data", "cores").mapInArrow(blocks, "core long, place long, first long, strings array<long>")) as every:
        strings = _shared(every).select("place", "first", F.posexplode("strings").alias("i", "core"))
        with stored(strings.select("core", "place", (F.col("first") + F.col("i")).alias("first"))) as every:
            return durable(_shared(every).groupBy("place").agg(F.collect_set("first").alias("passages")).join(keys, "place").select("key", "passages"))


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, passage: int = PASSAGE, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes that stay (null without with_kept).

    Then n_passages, the maximal runs of words in strings of `passage` words that another document holds too, and passage_words, the words in them.
    """
    spark = docs.sparkSession
    ship(spark)
    data = F.encode(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), data.alias("data")).select("doc_id", "data", F.unhex(F.md5("data")).alias("key"))
    names = rows.select("doc_id", "key")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text of a task once, as far as SEEN keys can tell."""
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    new.append(i)
                    if len(seen) < SEEN:
                        seen.add(key)
            yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int32()))

    def runs_of(first: np.ndarray) -> tuple[int, int]:
        """How many runs the strings that start at these words make, and their words."""
        steps = np.diff(first)
        return int((steps > passage).sum()) + (len(first) > 0), int(np.minimum(steps, passage).sum()) + passage * (len(first) > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages", "passage_words"]
        kinds = [pa.binary(), *[pa.int64()] * 3, pa.string(), pa.binary(), *[pa.int64()] * 2]
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for key, data, parts, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                data = data.as_py()
                kept, at, n = [], 0, 0
                spans = sorted((p["first"], p["end"] + length - 1) for p in parts or [])
                n_passages, passage_words = runs_of(np.sort(found.values.to_numpy(zero_copy_only=False)) if found.is_valid else np.empty(0, np.int64))
                if spans and spans[0][0] < 0:  # the whole text is there twice
                    spans = [(0, len(data))] if len(data) >= length else []
                    words = len(word_hashes(data))
                    n_passages, passage_words = (1, words) if words >= passage else (0, 0)
                for s, e in spans:
                    if s > at or not n:
                        n += 1
                        kept.append(data[at:s])
                    at = max(at, e)
                kept = b"".join([*kept, data[at:]])
                for c, v in zip(rows, (key, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if with_kept else None, n_passages, passage_words), strict=True):
                    c.append(v)
            yield _batch(fields, kinds, rows)

    distinct = rows.select("key", "data").mapInArrow(once, "key binary, data binary")
    with bucketed(distinct.repartition("key"), "key") as texts:
        passages = shared_passages(texts, passage=passage, gram=min(WORDS, passage))
        spans = repeated_windows(texts, length=length, gram=gram, block=block)
        copies = names.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("end"))
        parts = spans.unionByName(copies).groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("parts"))
        own = texts.join(parts, "key", "left").join(passages, "key", "left").select("key", "data", "parts", "passages")
        by_key = durable(own.mapInArrow(cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passages long, passage_words long").dropDuplicates(["key"]))
    return names.join(by_key, "key").drop("key")
