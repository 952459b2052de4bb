"""Rows of chosen videos, and an inventory of tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.strings import WATCH_URL, id_after_equals, size_pretty, url_of
from ..operators.joins import Keys, restrict, short_list
from ..sources.files import list_objects


def transcript_of(transcripts: DataFrame, video_id: str) -> DataFrame:
    return transcripts.where(F.col("url") == WATCH_URL + video_id).orderBy("segment_id")


def transcripts_of(transcripts: DataFrame, video_ids: Keys) -> DataFrame:
    """Whole transcripts in order, with ``video_id``; ids are a list or a frame."""
    if isinstance(video_ids, DataFrame):
        urls: Keys = short_list(video_ids.select(url_of(F.col(video_ids.columns[0])).alias("url")))
    else:
        urls = [WATCH_URL + v for v in video_ids]
    picked = restrict(transcripts, urls, "url").withColumn("video_id", id_after_equals(F.col("url")))
    return picked.orderBy("url", "segment_id")


def metadata_of(metadata: DataFrame, video_id: str) -> DataFrame:
    return metadata.where(F.col("url") == WATCH_URL + video_id)


def metadata_of_many(metadata: DataFrame, video_ids: Keys) -> DataFrame:
    return restrict(metadata, short_list(video_ids), "id")


def video_counts(tables: Mapping[str, DataFrame], key: str = "url", approximate: bool = False) -> DataFrame:
    """Distinct videos per table."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    parts = [
        df.agg(count(F.col(key)).alias("video_count")).select(F.lit(name).alias("table"), "video_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def table_inventory(
    tables: Mapping[str, DataFrame], paths: Mapping[str, str], index_paths: Mapping[str, str] | None = None
) -> DataFrame:
    """Distinct videos and sizes per table; ``index_paths`` are index files of a table."""
    spark = next(iter(tables.values())).sparkSession
    index_paths = index_paths or {}

    def size(path: str | None) -> DataFrame:
        if path is None:
            return spark.range(1).select(F.lit(0).cast("bigint").alias("bytes"))
        return list_objects(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))

    sizes = reduce(
        DataFrame.unionByName,
        [
            size(paths[name]).withColumnRenamed("bytes", "_table")
            .crossJoin(size(index_paths.get(name)).withColumnRenamed("bytes", "_index"))
            .withColumn("table", F.lit(name))
            for name in tables
        ],
    )
    return (
        video_counts(tables)
        .join(sizes, "table")
        .select(
            "table",
            size_pretty(F.col("_table") + F.col("_index")).alias("total_size"),
            size_pretty(F.col("_table")).alias("table_size"),
            size_pretty(F.col("_index")).alias("indexes_size"),
            "video_count",
        )
    )
