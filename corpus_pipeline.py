"""Corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; each is written as Parquet and read again as the next one's docs. All but
the last keep the columns of documents, in place and type; further columns of docs, whatever their names, go along with their rows.
Decisions are made for rows, not identifiers. Null texts have no language and end at the first stage; an empty table stays empty.

Each stage's table is for the next one to read, and its rows are long: stages ask the session for row groups of 8 MB (`ROW_GROUP`,
unless it has a size of its own), since a writer holds a whole row group in memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dissona.llm import decon, langid, packing, secrets, simhash
from dissona.runtime import ROW_GROUP, durable, remove, shared_dir, table


def small_row_groups(spark: SparkSession) -> None:
    for name, value in (ROW_GROUP, ("parquet.page.size", str(128 << 10))):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language, set to lang; without a letter or without a leading language they go."""
    small_row_groups(spark)
    return langid.keep_languages(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that op3's links make (3-word shingles, 3 of 64 bits): one with the least doc_id."""
    return simhash.drop_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decon.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, without the ids themselves."""
    return packing.pack_documents(docs, with_ids=False).drop("ids")


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("secret_scan", redact_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; the folders go when the result is there."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        return durable(docs)
    finally:
        remove(spark, folder)
