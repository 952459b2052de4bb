"""The serving update: deltas from the warehouse, loading, and rebuilt search tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ivf, word_index
from ..operators.chunks import chunk_to_text, refresh_chunk_text
from ..operators.joins import absent
from ..schemas import SERVING_TABLES
from ..session import to_scratch
from ..sources import sinks
from . import jobs
from .chunk_search import SearchTables


@dataclass(frozen=True)
class UpdateSettings:
    """Bounds of one update; ``max_videos=None`` takes all, ``cells=None`` builds no vector index.

    With ``words_folder`` the words of new segments join the stored index of stems that lies there.
    With ``text_folder`` chunk texts lie there, and only those of changed urls are worked out.
    """

    max_videos: int | None = 100
    cells: int | None = None
    index_folder: str | None = None
    recreate_tables: bool = False
    null_aware: bool = False
    words_folder: str | None = None
    text_folder: str | None = None


def _served(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    return {name: spark.table(f"{database}.{name}") for name in SERVING_TABLES}


def update_serving(
    spark: SparkSession,
    warehouse: Mapping[str, DataFrame],
    vectors: DataFrame,
    database: str,
    settings: UpdateSettings = UpdateSettings(),
) -> SearchTables:
    """Bring the serving tables of ``database`` up to date and return them.

    ``warehouse`` holds ``video_metadata``, ``enriched_video_metadata``,
    ``transcriptions`` and ``embeddings``; ``vectors`` holds ``id, embedding``.
    All deltas are fixed before the first row is written, since each of them
    reads what the others change.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    sinks.initialize_tables(spark, tuple(SERVING_TABLES), settings.recreate_tables, serving=True, database=database)
    served = _served(spark, database)
    videos, segments, chunks = (warehouse[n] for n in ("video_metadata", "transcriptions", "embeddings"))
    fresh = jobs.embeddings_delta(chunks, served["embeddings"], settings.max_videos, settings.null_aware)
    deltas = {
        "video_metadata": jobs.metadata_delta(
            videos, warehouse["enriched_video_metadata"], segments, chunks, served["video_metadata"], settings.null_aware
        ),
        "transcriptions": jobs.transcripts_delta(
            videos, segments, chunks, served["video_metadata"], served["transcriptions"], settings.null_aware
        ),
        "embeddings": jobs.with_vectors(fresh, vectors),
    }
    fixed = {name: to_scratch(df, name) for name, df in deltas.items()}
    # Words come before their segments: a batch that is indexed twice counts once, a missing one would be lost.
    words = _indexed_words(spark, settings, served["transcriptions"], fixed["transcriptions"])
    # What counts as served follows from the metadata, so it is appended last: a run that stops before
    # leaves its videos to the next one, which skips the rows that are there already.
    for name in ("embeddings", "transcriptions", "video_metadata"):
        sinks.append(fixed[name], f"{database}.{name}")

    served = _served(spark, database)
    texts = None
    if settings.text_folder:
        texts = _refreshed_texts(spark, settings.text_folder.rstrip("/"), served, fixed)
    else:
        sinks.replace(chunk_to_text(served["embeddings"], served["transcriptions"]), f"{database}.embeddings_to_text")
    index = None
    if settings.cells and settings.index_folder:
        path = f"{settings.index_folder.rstrip('/')}/index-{uuid.uuid4().hex}"
        index = ivf.build(served["embeddings"], path, settings.cells)
    tables = search_tables(spark, database, index, words)
    return tables if texts is None else replace(tables, chunk_text=texts)


def _refreshed_texts(
    spark: SparkSession, folder: str, served: Mapping[str, DataFrame], fresh: Mapping[str, DataFrame]
) -> DataFrame:
    """Chunk texts of a folder, worked out anew for new rows and for chunks that have none yet."""
    chunks, changed = served["embeddings"], None
    try:
        known = spark.read.parquet(folder).select(F.concat_ws(" ", "url", "id").alias("key"))
    except AnalysisException:
        known = None
    if known is not None:
        # A run that stopped before its texts were written left chunks without one.
        waiting = absent(chunks.select("url", F.concat_ws(" ", "url", "id").alias("key")), known, "key").select("url")
        changed = waiting.union(fresh["embeddings"].select("url")).union(fresh["transcriptions"].select("url"))
    refresh_chunk_text(chunks, served["transcriptions"], folder, changed)
    return spark.read.parquet(folder).drop("bucket")


def _indexed_words(
    spark: SparkSession, settings: UpdateSettings, served: DataFrame, fresh: DataFrame
) -> word_index.WordIndex | None:
    if not settings.words_folder:
        return None
    words = word_index.WordIndex(settings.words_folder.rstrip("/"), stemmed=True).opened(spark)
    for segments in (fresh,) if words.parts else (served, fresh):
        words = word_index.add(words, segments)
    return words


def search_tables(
    spark: SparkSession, database: str, index: ivf.IvfIndex | None = None, words: word_index.WordIndex | None = None
) -> SearchTables:
    """The tables of a database as the searches want them."""
    served = _served(spark, database)
    return SearchTables(
        served["embeddings"], served["transcriptions"], served["video_metadata"], served["embeddings_to_text"],
        index=index, postings=words,
    )
