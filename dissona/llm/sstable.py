"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier (and, for identifiers that recur, a hash of the text, so that one identifier's rows
may spread over tasks), sorted, encoded and written, one pass, each task its shards. A shard:

    magic | data blocks | index | Bloom filter | footer

A data block holds entries in key order: varints of the key bytes shared with the entry before, of those that follow, and of the
value's bytes; then the key's rest and the value. A block starts with a whole key; it is compressed with zstd and ends with a
crc32. The sparse index has each block's first key, place and size. The footer (fixed size, at the end) has the places of index and
filter, the counts and the width of an id. A lookup reads the footer, asks the filter, finds the block by binary search, reads it.

Keys: a byte 0 for a null identifier (else 1), then the identifier big-endian with its sign bit turned. Shards are written under a
task's own name and renamed, so a task that is run again puts the same shard in the same place. The folder lies in the shared
folder of the cluster; the manifest has one row per shard.

Defined cases: a null or empty text is the end id alone; null identifiers come first and stay null; repeated rows and identifiers
are kept, in the order of their texts; an empty table gives no shards and no rows; other columns are ignored; a text is one value,
whatever its length, and a block that it fills alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.runtime import shared_dir, ship

from .common import id_and_text
from .tokens import coder, default_path

MAGIC = b"DSSTAB01"
FOOTER = struct.Struct("<QQQQBBQQ8s")  # index place, size; filter place, size; filter hashes, id width; entries, ids; magic
BLOCK, SHARD = 64 << 10, 256 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_bits(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The bit numbers of each key, a row each: double hashing of one 64-bit hash."""
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64).reshape(-1, 1)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a + b * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes one shard to a binary file object; add() in key order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.size, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.entries = self.ids = 0
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        head = varint(shared) + varint(len(key) - shared) + varint(len(value))
        self.block += [head, key[shared:], value]
        self.size += len(head) + len(key) - shared + len(value)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        if self.size >= BLOCK:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.index.append((self.first, self.at, len(data) + 4))
            self.put(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.size, self.last = [], 0, b""

    def close(self) -> None:
        self.end_block()
        index, index_at = self.pack(b"".join(varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)), self.at
        self.put(index)
        bits = np.zeros(-(-max(64, BLOOM_BITS * len(self.keys)) // 8) * 8, np.uint8)
        if self.keys:
            bits[bloom_bits(self.keys, len(bits), BLOOM_HASHES).astype(np.int64).ravel()] = 1
        bloom, bloom_at = np.packbits(bits).tobytes(), self.at
        self.put(bloom)
        self.put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), BLOOM_HASHES, self.width, self.entries, self.ids, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file object: entries() in order, get() by binary search."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        index_at, index_n, self.bloom_at, self.bloom_n, self.hashes, self.width, self.entries_n, self.ids_n, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, at, self.index = self.unpack(self.read(index_at, index_n)), 0, []
        while at < len(data):
            n, at = read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QI", data, at + n)))
            at += n + 12

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        raw = self.read(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a damaged block")
        data, i, key = self.unpack(raw[:-4]), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            rest, i = read_varint(data, i)
            size, i = read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + size]
            i += size

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index:
            yield from self.block(at, n)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an identifier, in order."""
        key = key_of(doc_id)
        bits = np.unpackbits(np.frombuffer(self.read(self.bloom_at, self.bloom_n), np.uint8))
        if not bits[bloom_bits([key], len(bits), self.hashes).astype(np.int64).ravel()].all():
            return []
        out = []
        for first, at, n in self.index[max(0, bisect_left(self.index, (key,)) - 1) :]:
            if first > key:
                break
            out += [v for k, v in self.block(at, n) if k == key]
        return out


def open_shard(uri: str) -> ShardReader:
    store, path = fs.FileSystem.from_uri(uri)
    return ShardReader(store.open_input_file(path), store.get_file_info(path).size)


def write_shards(docs: DataFrame, folder: str, *, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = SHARD) -> list[dict]:
    """Writes the shards and the manifest to a folder by URI; gives the manifest: a dict for each shard, in key order."""
    ship(docs.sparkSession)
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        width = 2 if len(code.packed) <= 1 << 16 else 4
        store, base = fs.FileSystem.from_uri(folder)
        task, made, writer, own, final, first = TaskContext.get(), [], None, "", "", b""

        def finish() -> None:
            writer.close()
            out.close()
            store.move(own, final)
            made.append({"shard": final.rsplit("/", 1)[1], "part": task.partitionId(), "entries": writer.entries, "ids": writer.ids, "bytes": writer.at, "first": first, "last": writer.last_key})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    final = f"{base}/shard-{task.partitionId():06d}-{len(made):04d}.sst"
                    own = f"{final}.{task.taskAttemptId()}.tmp"
                    out = store.open_output_stream(own)
                    writer, first = ShardWriter(out, width), key_of(doc)
                ids = code.ids(text.as_py()) + end
                writer.add(key := key_of(doc), np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids)
                writer.last_key = key
                if writer.at >= shard_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("shard", pa.string()), ("part", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]))

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    rows = id_and_text(docs, id_column, text_column).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    made = sorted((r.asDict() for r in rows.mapInArrow(run, "shard string, part long, entries long, ids long, bytes long, first binary, last binary").collect()), key=lambda r: r["shard"])
    start = 0
    for r in made:
        r["start"], start = start, start + r["ids"]
    with store.open_output_stream(f"{base}/MANIFEST.json") as out:
        out.write(json.dumps([r | {"first": r["first"].hex(), "last": r["last"].hex()} for r in made]).encode())
    return made


def read_shards(spark: SparkSession, folder: str, manifest: list[dict], *, with_ids: bool = True) -> DataFrame:
    """One row per document, from the shards: doc_id, start, n_tokens, ids_crc32 and ids, little-endian unsigned 32-bit (null without with_ids)."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = open_shard(f"{folder}/{shard}")
                rows: list[list] = [[], [], [], [], []]
                for key, value in reader.entries():
                    ids = value if reader.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    for c, v in zip(rows, (id_of(key), start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None), strict=True):
                        c.append(v)
                    start += len(ids) // 4
                    if len(rows[0]) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], schema.replace(" long", "").replace(" binary", "").split(", "))
                        rows = [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], schema.replace(" long", "").replace(" binary", "").split(", "))

    shards = spark.createDataFrame([(r["shard"], r["start"]) for r in manifest], "shard string, start long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sstable-{uuid.uuid4().hex}"
