"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# White space as the contracts define it: blank and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; white space alone gives an empty one."""
    return F.array_remove(F.split(text, SPACES + "+", -1), F.lit(""))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows in one struct ``row``, beside helper columns that no name of a row can clash with."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*fields).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The whole rows of ``packed`` again, under their names."""
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def field(docs: DataFrame, name: str) -> str:
    """Where ``packed`` rows hold a column."""
    return f"row.c{docs.columns.index(name)}"


def arrow(df: DataFrame, task, schema: StructType) -> DataFrame:
    """Run ``task(batches of dicts of columns) -> dicts of columns`` in each partition.

    Batches come and go through Arrow; a task sees one batch at a time, so its
    memory is bounded by Spark's batch limits plus what it keeps itself.
    """
    layout = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in task(batches):
            if len(next(iter(columns.values()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in layout], schema=layout
                )
        # Workers are used again; what this task freed goes back to the machine.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Send at most so many rows to a Python worker at once, for jobs on whole texts that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, for tasks that turn rows into Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def empty_as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
