"""Writing and replacing tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import WAREHOUSE_TABLES, table_schema


def append(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> None:
    """Append to a table, or to a Parquet path when ``target`` contains a slash.

    Columns are matched by name.
    """
    if "/" in target:
        (df.select(*columns) if columns else df).write.mode("append").parquet(target)
        return
    names = columns or df.sparkSession.table(target).columns
    df.select(*names).write.mode("append").insertInto(target)


def append_clustered(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Append to a Parquet path in ranges of the ``by`` columns.

    A search for a few urls then reads only the row groups whose range holds
    them.  Name a second column, such as the segment number, so that one very
    long video is spread over several files.
    """
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 10_000, **options: str) -> None:
    """Append to a table of another database, ``batch_rows`` per statement."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_rows), **options).mode("append").save()


def replace(df: DataFrame, table: str) -> None:
    """Replace a table, also with a frame that reads from it.

    The new rows are complete in a table of their own before the old one goes.
    """
    spark = df.sparkSession
    staged = f"{table}__{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(staged)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")


def create_table(spark: SparkSession, name: str, schema: T.StructType, delete_if_exists: bool = False) -> None:
    """An empty table with the schema's columns, unless it exists already."""
    if delete_if_exists:
        drop_table(spark, name)
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def initialize_tables(
    spark: SparkSession,
    tables: Sequence[str] = tuple(WAREHOUSE_TABLES),
    delete_existing: bool = False,
    serving: bool = False,
    database: str | None = None,
) -> None:
    """Create the named tables; an unknown name is a KeyError."""
    for name in tables:
        schema = table_schema(name, serving)
        create_table(spark, f"{database}.{name}" if database else name, schema, delete_existing)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def add_column_once(df: DataFrame, name: str, derive: Callable[[DataFrame], Column]) -> DataFrame:
    """Add a derived column unless the frame has it already."""
    return df if has_column(df, name) else df.withColumn(name, derive(df))


def as_json(df: DataFrame, out: str = "record") -> DataFrame:
    """Every row as one JSON object; nulls are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))
