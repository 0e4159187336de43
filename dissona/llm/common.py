"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.runtime import ship


def map_rows(df: DataFrame, function: Callable[[list[list]], list[list]], schema: str, fields: list[pa.DataType], rows: int = 1024) -> DataFrame:
    """mapInArrow over at most `rows` input rows at a time: function gets the columns as lists and returns columns as lists or arrays."""
    ship(df.sparkSession)
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = function([c.to_pylist() for c in batch.slice(at, rows).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1024) -> DataFrame:
    """df with some rows left out or values replaced, by a function of at most `rows` rows at a time; columns count by place, whatever their names."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))

    return df.mapInArrow(run, df.schema)


def replaced(batch: pa.RecordBatch, at: int, values: pa.Array) -> pa.RecordBatch:
    """batch with another column at a place, cast to its type."""
    columns = list(batch.columns)
    columns[at] = values.cast(batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, renamed; other columns, whatever their names, stay out of the plan."""
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
