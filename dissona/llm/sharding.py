"""Shards of near equal bytes, by sampled splitters.

Records are sorted by (hash of the text, identifier, number in the table) and the sorted order is cut into shards, so equal texts stand
together. The order is never laid out whole: a sample of keys, drawn with a chance in proportion to a record's size, gives the
quantiles that cut it into ranges, many for each shard. All records are then counted by range. A range with more than its share is
subdivided at quantiles of a sample of its own: between texts first, and where a single text fills it, by identifier and number. That
goes on until each range holds its share or a single record. Ranges are small, so each is sorted by itself; its place in the whole
follows from the ranges before it, which the driver adds up (a row for each range, their number is bounded).

A shard ends where its share of the bytes does: a text goes with all its copies to the shard that its middle byte falls to, unless its
copies fill a range by themselves; those are cut record by record. So shards differ by less than two records or two ranges.

Only the narrow records are sorted; texts are read for their size, checksum and hash, or travel with them in `write_shards`.

Defined cases: a null text has no bytes, so size 1 and the checksum of nothing, as has an empty one; a null identifier stays null and
comes first among equal texts; repeated rows are records of their own; texts with one hash count as equal here; an empty table gives
an empty result; other columns, whatever their names, are not read (write_shards keeps them within a struct); texts are read whole. With
fewer records than shards some shards are empty.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.runtime import durable, ship

#: Ranges at the least, and at the most; a range for as many records in between. Sampled keys a range. The most of its share that a range keeps.
RANGES, MOST_RANGES, RANGE_ROWS, KEYS, OVERFULL, ROUNDS = 512, 16384, 1 << 20, 16, 2.0, 64
LOWEST = np.iinfo(np.int64).min
Key = tuple[int, int, int]


def _records(docs: DataFrame, id_column: str, text_column: str, whole: bool) -> DataFrame:
    """doc_id, size, crc, h, place (0 in this table is the first), and the whole row if asked for. Written, so that numbers hold."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []))
    return durable(rows.withColumn("place", F.monotonically_increasing_id()))


def _bytes(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys as strings of 24 bytes that sort as the keys do."""
    flip = np.uint64(1 << 63)
    return (np.stack([h, doc, place], 1).astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view("S24").ravel()


class Splitters:
    """Sorted keys that begin a range; range 0 begins before all."""

    def __init__(self, keys: list[Key]):
        self.keys = sorted(set(keys))
        self.sorted = _bytes(*np.array(self.keys, np.int64).reshape(-1, 3).T)

    def of(self, h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sorted, _bytes(h, doc, place), side="right").astype(np.int32)


def _ranged(records: DataFrame, splitters: Splitters) -> DataFrame:
    """records with the number of their range."""
    ship(records.sparkSession)
    schema = T.StructType([*records.schema.fields, T.StructField("range", T.IntegerType())])
    names, at = schema.names, [records.columns.index(c) for c in ("h", "doc_id", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, doc, place = (b.column(i).fill_null(int(LOWEST)).to_numpy() for i in at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splitters.of(h, doc, place))], names)

    return records.mapInArrow(run, schema)


def _sampled(records: DataFrame, share: float, seed: int) -> list[Key]:
    """Keys, sorted, KEYS for each share of bytes: a record is drawn as often as its size says, a fraction by chance.

    The draw follows from the key, so a task that runs again draws the same.
    """
    chance = F.shiftrightunsigned(F.xxhash64("h", "doc_id", "place", F.lit(seed)), 11) / F.lit(float(1 << 53))
    times = F.floor(F.col("size") * F.lit(KEYS / share) + chance)
    drawn = records.select("h", F.coalesce("doc_id", F.lit(int(LOWEST))), "place", times.alias("times")).filter("times > 0").toArrow()
    return sorted(key for *key, n in zip(*(c.to_pylist() for c in drawn.columns), strict=True) for key in [tuple(key)] * n)


def _between_texts(sample: list[Key]) -> list[Key]:
    """The quantiles, moved to the beginnings of their texts; a text that takes up more than one ends a range as well."""
    out, before = [], None
    for h, _, _ in sample[KEYS // 2 :: KEYS]:
        out.append((h, int(LOWEST), int(LOWEST)))
        if h == before and h < np.iinfo(np.int64).max:
            out.append((h + 1, int(LOWEST), int(LOWEST)))
        before = h
    return out


def _split(records: DataFrame, ranges: int) -> tuple[Splitters, list[tuple]]:
    """Splitters, and of each range that has records: range, bytes, rows, first h, last h, in order."""
    total = records.agg(F.sum("size")).first()[0]
    share = total / ranges
    keys = _between_texts(_sampled(records, share, 0))
    settled: set[Key | None] = set()
    for seed in range(1, ROUNDS):
        splitters = Splitters(keys)
        ranged = _ranged(records, splitters)
        counts = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h")).collect())
        begin = lambda r: splitters.keys[r - 1] if r else None
        over = {r[0]: r for r in counts if r[1] > OVERFULL * share and r[2] > 1 and begin(r[0]) not in settled}
        if not over:
            return splitters, counts
        drawn = _sampled(ranged.filter(F.col("range").isin(list(over))), share, seed)
        of = splitters.of(*np.array(drawn, np.int64).reshape(-1, 3).T) if drawn else []
        before, by_range = set(keys), defaultdict(list)
        for k, r in zip(drawn, of, strict=True):
            by_range[int(r)].append(k)
        for r, (_, _, _, low, high) in over.items():
            own = by_range[r]
            new = set(own[KEYS // 2 :: KEYS] if low == high else _between_texts(own)) - before
            if not new:
                settled.add(begin(r))  # nothing but the key that begins it was drawn
            keys += new
    return splitters, counts


def assign_shards(docs: DataFrame, shards: int = 8, *, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null, as no shard keeps its rows when there is one more); `row` if whole."""
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *(["row"] if whole else [])]
    records = _records(docs, id_column, text_column, whole)
    n = records.count()
    splitters, counts = _split(records, ranges or min(MOST_RANGES, max(RANGES, n // RANGE_ROWS))) if n else (Splitters([]), [])
    total = sum(r[1] for r in counts)
    begun = Counter(k[0] for k in splitters.keys)  # a text that is cut begins more than one range
    offsets, bytes_before, rows_before = [], 0, 0
    for r, size, rows, low, high in counts:
        offsets.append((r, bytes_before, rows_before, low == high and begun[low] > 1))
        bytes_before, rows_before = bytes_before + size, rows_before + rows
    ranges_of = records.sparkSession.createDataFrame(offsets, "range int, bytes_before long, rows_before long, cut boolean")
    order = Window.partitionBy("range").orderBy("h", F.asc_nulls_first("doc_id"), "place")
    text = Window.partitionBy("range", "h")
    x = _ranged(records, splitters).withColumn("after", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("number", F.row_number().over(order) - 1)
    x = x.withColumn("text_after", F.max("after").over(text)).withColumn("text_size", F.sum("size").over(text)).join(F.broadcast(ranges_of), "range")  # a row for each range
    middle = F.col("bytes_before") + F.when(F.col("cut"), F.col("after") - F.col("size") / 2).otherwise(F.col("text_after") - F.col("text_size") / 2)
    x = durable(x.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int")).withColumn("at", F.col("rows_before") + F.col("number")))
    first = x.groupBy(F.col("shard")).agg(F.min("at").alias("first"))
    out = x.join(F.broadcast(first), "shard")  # a row for each shard
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if whole else [])).select(*names)


def write_shards(docs: DataFrame, folder: str, shards: int = 8, **options) -> None:
    """The rows (a struct, row) by shard as Parquet, a folder each; slot tells their order."""
    assign_shards(docs, shards, whole=True, **options).select("shard", "slot", "row").write.partitionBy("shard").parquet(folder)
