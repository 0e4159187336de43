"""Incremental ingest: files that arrive become documents once, whatever is replayed."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dissona.operators.chunking import chunk_documents
from dissona.operators.store import payload_assertions
from dissona.runtime import durable, exists
from dissona.sources.readers import load_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


SLICES = 256


def append_new(batch: DataFrame, target: str, key: str, slices: int = SLICES) -> None:
    """Appends the rows whose key the table lacks; a batch that is run again adds nothing.

    The table is partitioned by a hash of the key into slices, always as many, so of its keys only those in the batch's slices are read.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")
    fresh = durable(batch.dropDuplicates([key]).withColumn("slice", part))
    if exists(spark, target):
        own = [r["slice"] for r in fresh.select("slice").distinct().collect()]  # at most all slices
        there = spark.read.parquet(target).filter(F.col("slice").isin(own)).select(key)
        fresh = fresh.join(there, key, "left_anti")
    fresh.repartition("slice").write.mode("append").partitionBy("slice").parquet(target)


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, corpus_id: str) -> StreamingQuery:
    """All files there are now, in micro-batches, into target/documents with the text, and a row of counts per batch into target/progress."""

    def batch(files: DataFrame, number: int) -> None:
        docs = load_files(files).withColumn("corpus_id", F.lit(corpus_id))
        append_new(docs, os.path.join(target, "documents"), "doc_id")
        append_new(files.agg(F.count("*").alias("n_files")).withColumn("batch", F.lit(number)), os.path.join(target, "progress"), "batch")

    return watch(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class Steps:
    """What a corpus goes through after its files are documents.

    extract: chunks (chunk_id, doc_id, text) to payloads (doc_id, chunk_id, claims, definitions); embed: assertions (assertion_id,
    assertion_text) to vectors (assertion_id, embedding).
    """

    extract: Callable[[DataFrame], DataFrame]
    embed: Callable[[DataFrame], DataFrame]
    max_chars: int = 1000
    overlap_chars: int = 0


STAGES = ("documents", "chunks", "assertions", "vectors")


def ingest_corpus(spark: SparkSession, folder: str, target: str, checkpoint: str, corpus_id: str, steps: Steps, *, files_per_batch: int = 1000, slices: int = SLICES, after: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """All files there are now, in micro-batches, into tables of target: documents, chunks, assertions, vectors.

    Each stage appends the rows whose content key its table lacks, then marks the batch as done in the checkpoint's folder. A batch that
    was broken off between stages, or within one, is run again by the stream: stages that are marked are passed over, so no model is
    asked anew for what it has answered, and rows that had arrived aren't added twice. Another checkpoint replays all files and
    changes nothing but what is missing. `after`, if given, is called with stage and batch once a stage is marked.
    """

    def batch(files: DataFrame, number: int) -> None:
        docs = durable(load_files(files).withColumn("corpus_id", F.lit(corpus_id)))
        table = lambda name: os.path.join(target, name)
        chunks = chunk_documents(docs, max_chars=steps.max_chars, overlap_chars=steps.overlap_chars)  # follows from the files, so it can be made again

        def assertions() -> DataFrame:
            there = chunks.join(known(table("assertions"), "chunk_id"), "chunk_id", "left_anti")  # of these chunks no answer is there
            return payload_assertions(steps.extract(there))

        def known(path: str, key: str) -> DataFrame:
            return spark.read.parquet(path).select(key).distinct() if exists(spark, path) else spark.createDataFrame([], f"{key} string")

        def vectors() -> DataFrame:
            own = spark.read.parquet(table("assertions")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
            return steps.embed(pending_embeddings(own, known(table("vectors"), "assertion_id")))

        for stage, key, rows in zip(STAGES, ("doc_id", "chunk_id", "assertion_id", "assertion_id"), (lambda: docs, lambda: chunks, assertions, vectors), strict=True):
            mark = f"{checkpoint}/stages/{stage}/{number}"
            if not exists(spark, mark):
                append_new(rows(), table(stage), key, slices)
                spark.range(1).coalesce(1).write.mode("overwrite").parquet(mark)
                if after is not None:
                    after(stage, number)

    return watch(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_embeddings(assertions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Assertions without a vector, of all corpora."""
    return assertions.join(embeddings.select("assertion_id"), "assertion_id", "left_anti")


def progress(query: StreamingQuery) -> list[dict]:
    """What the micro-batches so far have read."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
