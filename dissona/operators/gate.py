"""Candidate gates: pairs of assertions worth a judgement."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.runtime import durable, remove, shared_dir, ship

#: Bytes of a matrix that goes along with the code, of a block of similarities, of a block of vectors in a file, and of the rows a task holds against them.
MATRIX_BYTES, SIMS_BYTES, BLOCK_BYTES, HELD_BYTES, PIVOTS = 16 << 20, 16 << 20, 8 << 20, 16 << 20, 1024
_NEAR, _NAMES = "src long, dst long, score double", ["src", "dst", "score"]


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Array) else flat.to_numpy(), np.float64).reshape(-1, width)


def _first(source: np.ndarray, target_ids: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Places of the n entries of each source that come first: more similar, then the lesser id; by source."""
    order = np.lexsort([target_ids, -value, source])
    s = source[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    within = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return order[within < n]


def nearest(rows: np.ndarray, all_ids: np.ndarray, all_rows: np.ndarray, n: int, sims_bytes: int = SIMS_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, target id, similarity (nine decimals) of the n most similar targets of each row, the lesser id first among equals.

    Similarities are laid out in blocks of sims_bytes, however many targets there are.
    """
    parts, step = [], max(1, sims_bytes // (8 * max(1, len(all_ids))))
    for at in range(0, len(rows), step):
        sims = rows[at : at + step] @ all_rows.T
        np.round(sims, 9, out=sims)
        if n < len(all_ids):
            edge = np.partition(sims, len(all_ids) - n, axis=1)[:, [len(all_ids) - n]]
            source, target = np.nonzero(sims >= edge)
        else:
            source, target = (x.ravel() for x in np.indices(sims.shape))
        value = sims[source, target]
        keep = _first(source, all_ids[target], value, n)
        parts.append((source[keep] + at, all_ids[target[keep]], value[keep]))
    if not parts:
        return np.empty(0, np.int64), all_ids[:0], np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def top_neighbours(vectors: DataFrame, k: int, *, id_column: str = "id", vector_column: str = "embedding", least: float | None = None, matrix_bytes: int = MATRIX_BYTES, block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """src, dst, score: for each vector its k + 1 nearest by cosine over all vectors, itself among them. Ids are longs; null vectors are left out.

    With `least`, pairs less similar may be left out, as they come after all others. The whole matrix goes to the executors if it is
    counted to fit in matrix_bytes; otherwise see `_streamed`.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[vector_column].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("v")).filter("id is not null and v is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], _NEAR)
    if n * width * 8 > matrix_bytes:
        return _streamed(rows, k, n, width, kind, least, block_bytes, held_bytes)
    found = rows.toArrow()
    all_ids, whole = found.column(0).to_numpy(), _unit(_matrix(found.column(1), width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, target, value = nearest(_unit(_matrix(b.column(1), width)), all_ids, whole, k + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source)), pa.array(target), pa.array(value)], _NAMES)

    return rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(scan, _NEAR)


def _streamed(rows: DataFrame, k: int, n: int, width: int, kind: str, least: float | None, block_bytes: int, held_bytes: int) -> DataFrame:
    """top_neighbours over vectors that are kept once, as files of blocks in the shared folder, exactly.

    A sample of the vectors, bounded by PIVOTS, are pivots. Vectors are dealt out once, by their nearest pivot, so a file holds vectors
    that point the same way; a small table says which pivots' vectors a file has and how far they are from theirs. A task holds
    held_bytes of rows and reads the files one by one, keeping the best k + 1 of each row so far. With a positive `least` a row
    passes over the files in which nothing can be as near by the triangle inequality of angles. No vector is sent to more than one
    task by a shuffle, and nothing in a task grows with the data but the table of files, a row for block_bytes of vectors.
    """
    spark = rows.sparkSession
    pruned = least is not None and least > 0
    reach = float(np.arccos(np.clip(least - 1e-9, -1, 1))) + 1e-7 if pruned else np.inf
    per_file = max(1, block_bytes // (8 * width))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-n // per_file))).toArrow()
    pivots = _unit(_matrix(sample.column(1), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot and the angle to it. With a positive `least`, zero vectors have no neighbours."""
        for b in batches:
            m = _unit(_matrix(b.column(1), width))
            if pruned:
                there = m.any(1)
                b, m = b.filter(pa.array(there)), m[there]
            a = np.arccos(np.clip(m @ pivots.T, -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a.argmin(1) if len(a) else [], pa.int32()), pa.array(a.min(1) if len(a) else [], pa.float64())], ["id", "v", "q", "angle"])

    folder = f"{shared_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    spread = max(spark.sparkContext.defaultParallelism, -(-n // per_file))
    placed = rows.mapInArrow(assign, f"id long, v {kind}, q int, angle double")
    placed.repartitionByRange(spread, "q", F.xxhash64("id")).sortWithinPartitions("q", "angle").write.option("maxRecordsPerFile", per_file).parquet(folder)
    stored = spark.read.schema(f"id long, v {kind}, q int, angle double").parquet(folder)
    files: dict[str, list[tuple[int, float]]] = {}
    for r in stored.groupBy(F.col("_metadata.file_name").alias("f"), "q").agg(F.max("angle").alias("r")).collect():  # a row for each file, and for each pivot
        files.setdefault(r["f"], []).append((r["q"], r["r"]))
    listed = [(f, np.array([q for q, _ in own]), np.array([r for _, r in own])) for f, own in sorted(files.items())]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors of held_bytes of rows at a time."""
        ids, parts, size = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy())
            parts.append(_unit(_matrix(b.column(1), width)))
            size += parts[-1].nbytes
            if size >= held_bytes:
                yield np.concatenate(ids), np.concatenate(parts)
                ids, parts, size = [], [], 0
        if size:
            yield np.concatenate(ids), np.concatenate(parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for ids, m in held(batches):
            source, target, value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for name, q, radius in listed:
                at = np.flatnonzero((np.arccos(np.clip(m @ pivots[q].T, -1, 1)) <= radius + reach).any(1)) if pruned else np.arange(len(m))  # a file's pivots only
                if not len(at):
                    continue
                with store.open_input_file(f"{base}/{name}") as f:
                    block = pq.read_table(f, columns=["id", "v"])
                s, t, v = nearest(m[at], block.column(0).to_numpy(), _unit(_matrix(block.column(1), width)), k + 1)
                if pruned:
                    near = v >= least
                    s, t, v = s[near], t[near], v[near]
                source, target, value = (np.concatenate(x) for x in ((source, at[s]), (target, t), (value, v)))
                keep = _first(source, target, value, k + 1)
                source, target, value = source[keep], target[keep], value[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[source]), pa.array(target), pa.array(value)], _NAMES)

    out = durable(stored.select("id", "v").mapInArrow(scan, _NEAR))
    remove(spark, folder)
    return out


def ann_gate(vectors: DataFrame, *, k: int = 20, threshold: float = 0.7, id_column: str = "id", doc_column: str = "doc_id", vector_column: str = "embedding") -> DataFrame:
    """a_id, b_id, score: unordered pairs of which either is among the other's k + 1 nearest, at the threshold or above, of different documents.

    Filters come after the choice of neighbours, so rows of one's own document use up places.
    """
    near = top_neighbours(vectors, k, id_column=id_column, vector_column=vector_column, least=threshold).filter((F.col("src") != F.col("dst")) & (F.col("score") >= threshold))
    pairs = near.groupBy(F.least("src", "dst").alias("a_id"), F.greatest("src", "dst").alias("b_id")).agg(F.max("score").alias("score"))
    docs = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(doc_column).alias("doc"))
    a, b = docs.select(F.col("id").alias("a_id"), F.col("doc").alias("a_doc")), docs.select(F.col("id").alias("b_id"), F.col("doc").alias("b_doc"))
    return pairs.join(a, "a_id").join(b, "b_id").filter("a_doc <> b_doc").select("a_id", "b_id", "score")


def all_pairs_gate(items: DataFrame, *, id_column: str = "id", doc_column: str = "doc_id", same_doc: bool = False) -> DataFrame:
    """Every unordered pair, of different documents unless same_doc, with score 1. Meant for small corpora: it is a loop over pairs."""
    x = items.select(F.col(id_column).alias("id"), F.col(doc_column).alias("doc"))
    a, b = x.select(F.col("id").alias("a_id"), F.col("doc").alias("a_doc")), x.select(F.col("id").alias("b_id"), F.col("doc").alias("b_doc"))
    on = F.col("a_id") < F.col("b_id")
    return a.join(b, on if same_doc else on & (F.col("a_doc") != F.col("b_doc"))).select("a_id", "b_id", F.lit(1.0).alias("score"))


def within_corpus(pairs: DataFrame, members: DataFrame, id_column: str = "id") -> DataFrame:
    """Pairs of which both ends are members."""
    m = members.select(F.col(id_column).alias("__m")).distinct()
    return pairs.join(m, F.col("a_id") == F.col("__m"), "left_semi").join(m.withColumnRenamed("__m", "__n"), F.col("b_id") == F.col("__n"), "left_semi")


def corpus_drops(pairs: DataFrame, members: DataFrame, id_column: str = "id") -> DataFrame:
    """n_kept, n_dropped of within_corpus, in one pass over the pairs."""
    m = members.select(F.col(id_column).alias("__m")).distinct()
    flagged = pairs.join(m.select(F.col("__m").alias("a_id"), F.lit(1).alias("a_in")), "a_id", "left").join(m.select(F.col("__m").alias("b_id"), F.lit(1).alias("b_in")), "b_id", "left")
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    return flagged.agg(F.count_if(both).alias("n_kept"), F.count_if(~both).alias("n_dropped"))
