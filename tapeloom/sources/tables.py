"""Tables by path or name, in-memory records, and named views."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T


def read_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table, or a Parquet path when ``source`` contains a slash."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Result of a SQL query on another database; pass partitioning in ``options``."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def from_records(spark: SparkSession, records: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """A table from a short list of records; missing fields are null."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = [tuple(r.get(f.name) for f in schema) for r in records]
    return spark.createDataFrame(rows, schema)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make frames available to SQL under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def temporary_view(df: DataFrame, name: str | None = None, replace: bool = False) -> str:
    """Register a view under ``name`` or a random name, and return the name.

    An existing view is an error unless ``replace`` is set.
    """
    name = name or f"tmp_{uuid.uuid4().hex[:10]}"
    (df.createOrReplaceTempView if replace else df.createTempView)(name)
    return name


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)
