"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered, 3-word shingles with repeats, joined by spaces (fewer
words: all of them as one shingle; none: fingerprint 0), XXH64 with seed 42 of each; a bit is set if over half the hashes have it.

Only distinct fingerprints are compared. Within the radius r, two fingerprints cut into r + k blocks agree in at least k of them, so
each goes once to a tile group for each choice of k blocks (the choice and its bits); no link is lost. With k = 1, 16 bits name a
group; beyond FINE fingerprints, of which such groups would hold hundreds each, k = 3 is taken: 20 choices of 32 bits. A group of up to `tile` members is
one tile. A larger group is cut into cells by population count, cells into tiles; only tile pairs whose counts differ by no more
than the radius are laid out, each a task's unit of its own, so a hot group spreads. Within a unit numpy compares all by exclusive-or
and bit counts, and a breadth-first search over the comparison matrix gives a forest of the unit's links: fewer links than
members, with the same components.

Defined cases: a null or empty text has fingerprint 0 and links with others near it; a null doc_id is linked like any other and
is never a component's id unless all are null (then null); repeated rows and identifiers give a row each; an empty table gives
an empty result; other columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.runtime import durable, rows_bound, ship

from .common import id_and_text, map_rows
from .graph import components

TILE, HOT_ROWS, BROADCAST_ROWS, FINE = 1024, 50_000, 200_000, 1 << 24


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    import xxhash

    hash_ = xxhash.xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = len(found)
    if n <= words:
        return hash_(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - words] + 1).tolist()]
    h = np.fromiter([hash_(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8", n - words + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""

    def run(columns: list[list]) -> list[list]:
        return [columns[0], np.array([fingerprint(t, words, seed) for t in columns[1]], np.uint64).view(np.int64)]

    return map_rows(id_and_text(docs, id_column, text_column), run, "doc_id long, fp long", [pa.int64(), pa.int64()])


def masks(radius: int, k: int = 1) -> list[int]:
    """The 64 bits in radius + k blocks: the bits of each choice of k of them."""
    edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, k)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within the radius of each other."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, counts = fps[order], counts[order].astype(np.int64)
    left, out = np.ones(len(fps), bool), []
    lows, highs = np.searchsorted(counts, counts - radius), np.searchsorted(counts, counts + radius, "right")
    for s in range(len(fps)):
        if not left[s]:
            continue
        left[s] = False
        queue = [s]
        while queue:
            at = queue.pop()
            lo, hi = lows[at], highs[at]
            near = np.flatnonzero(left[lo:hi] & (np.bitwise_count(fps[lo:hi] ^ fps[at]) <= radius)) + lo
            left[near] = False
            queue += near.tolist()
            out += [(int(fps[s].view(np.int64)), int(x)) for x in fps[near].view(np.int64)]
    return out


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE, k: int = 1) -> DataFrame:
    """a, b: links whose components are those of all links among distinct fingerprints (column fp)."""
    ship(distinct.sparkSession)
    parts = masks(radius, k)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(parts)))).alias("k")).select("fp", "k.block", "k.bits", F.bit_count("fp").cast("int").alias("ones"))
    cells = keyed.groupBy("block", "bits", "ones").count()
    hot = durable(cells.groupBy("block", "bits").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))).alias("cells")).filter(F.col("n") > tile).drop("n"))
    joined = keyed.join(F.broadcast(hot) if rows_bound(hot, HOT_ROWS) else hot, ["block", "bits"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.element_at("cells", F.col("ones"))).cast("int")
    around = F.flatten(F.transform(F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda q: F.map_contains_key("cells", q)), lambda q: F.transform(F.sequence(F.lit(0), F.element_at("cells", q) - 1), lambda t: F.struct(q.alias("q"), t.alias("t")))))
    own = F.struct(F.col("ones").alias("q"), F.col("mine").alias("t"))
    pairs = F.transform(F.col("around"), lambda x: F.struct(F.least(own, x).alias("low"), F.greatest(own, x).alias("high")))
    laid = joined.filter("cells is not null").withColumn("mine", mine).withColumn("around", around).select("fp", "block", "bits", F.explode(pairs).alias("unit"))
    nothing = F.lit(None).cast("struct<low:struct<q:int,t:int>,high:struct<q:int,t:int>>")
    units = joined.filter("cells is null").select("fp", "block", "bits", nothing.alias("unit")).unionByName(laid)
    units = units.select("fp", F.xxhash64("block", "bits", "unit").alias("unit"))  # a clash of two units only adds comparisons
    units = units.repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_unit, held = None, np.empty(0, np.uint64)
        for batch in _with_end(batches):
            out: list[tuple[int, int]] = []
            if batch is None:
                if len(held) > 1:
                    out = forest(held, radius)
            else:
                fps = batch.column(0).to_numpy().view(np.uint64)
                unit = batch.column(1).to_numpy()
                if not len(unit):
                    continue
                edges = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
                for s, e in zip(edges, [*edges[1:], len(unit)], strict=True):
                    if unit[s] == held_unit:
                        held = np.concatenate([held, fps[s:e]])
                    else:
                        if len(held) > 1:
                            out += forest(held, radius)
                        held_unit, held = unit[s], fps[s:e]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _least(found: DataFrame, least: Column, radius: int, tile: int) -> DataFrame:
    """fp and, of all rows in its component, the least value of a column."""
    by = durable(found.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(by.select("fp"), radius, tile, 1 if by.count() <= FINE else 3))
    named = by.join(roots, by.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return named.drop("least").join(named.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links."""
    found = durable(fingerprints(docs, id_column=id_column, text_column=text_column, words=words))
    classes = _least(found, F.col("doc_id"), radius, tile).withColumnRenamed("least", "component_id")
    return found.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """One row of docs of each component, all its columns: one with the least identifier (a null one last), and of these the least hash of the text.

    Rows that agree in both are one document; which of them stays is undefined. What goes is looked up by identifier and hash;
    if it is counted to be few rows it is broadcast, else the documents are dealt out.
    """
    who = (F.col(f"`{id_column}`").cast("long"), F.xxhash64(F.col(f"`{text_column}`").cast("string")))
    rows = docs.select(who[0].alias("i"), who[1].alias("t"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], np.array([fingerprint(t, words) for t in columns[2]], np.uint64).view(np.int64)]

    found = durable(map_rows(rows, run, "i long, t long, fp long", [pa.int64()] * 3))
    first = _least(found, F.struct(F.col("i").isNull().alias("n"), "i", "t"), radius, tile)
    counted = found.groupBy("i", "t", "fp").count().join(first, "fp").select("i", "t", "count", (F.col("i").eqNullSafe(F.col("least.i")) & (F.col("t") == F.col("least.t"))).alias("stays"))
    counted = durable(counted.filter("not stays or count > 1"))
    mark = uuid.uuid4().hex  # in names that no column of docs has
    keys = [f"i_{mark}", f"t_{mark}"]
    whole = docs.withColumns(dict(zip(keys, who, strict=True)))

    def by(part: DataFrame, how: str) -> DataFrame:
        other = part.select("i", "t").toDF("i2", "t2")
        if rows_bound(other, BROADCAST_ROWS):
            other = F.broadcast(other)
        return whole.join(other, whole[keys[0]].eqNullSafe(other.i2) & (whole[keys[1]] == other.t2), how)

    again = counted.filter("stays")
    left = by(counted, "left_anti").drop(*keys)
    return left if again.isEmpty() else left.unionByName(by(again, "left_semi").dropDuplicates(keys).drop(*keys))
