"""The daily jobs: work lists, new rows, and deltas to the serving tables.

Each job takes and returns frames; writing is a call of `sources.sinks`.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import times, titles
from ..functions.embed import Embedder, embed
from ..functions.strings import blob_uri
from ..operators.chunks import chunk_segments
from ..operators.joins import absent, absent_null_aware, first_keys, for_first_absent, present
from ..operators.rows import before_known, keep_first, union_first_wins
from ..schemas import TRANSCRIPTIONS, VIDEO_METADATA, conform
from ..session import to_scratch
from ..sources.documents import flatten_details, segments_from_results

MAX_TRANSCRIBED_MINUTES = 20


def latest_scrape(metadata: DataFrame) -> DataFrame:
    return metadata.agg(F.max("scrape_date").alias("latest"))


def most_recent_video(metadata: DataFrame) -> DataFrame:
    """Url of the newest video; the scrape date and then the url break ties."""
    newest = [F.col("publish_date").desc_nulls_last(), F.col("scrape_date").desc_nulls_last(), F.col("url")]
    return metadata.orderBy(*newest).limit(1).select("url")


def new_urls(
    listed: DataFrame,
    metadata: DataFrame,
    stop_at_most_recent: bool = True,
    fresh_days: float | None = None,
    clock: datetime | None = None,
) -> DataFrame:
    """Urls of a newest-first list (``url, position``) that are not known yet.

    The list is cut at the most recent known video.  Nothing is returned when
    the metadata is younger than ``fresh_days``.
    """
    once = listed.groupBy("url").agg(F.min("position").alias("position"))
    if stop_at_most_recent:
        once = before_known(once, most_recent_video(metadata), "url", "position")
    fresh = absent(once, metadata, "url")
    if fresh_days is None:
        return fresh
    gate = latest_scrape(metadata)
    return (
        fresh.crossJoin(F.broadcast(gate))
        .where(~times.is_fresh(F.col("latest"), fresh_days, clock))
        .drop("latest")
    )


def metadata_rows(raw: DataFrame, clock: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata rows of raw details documents, and the rows that lack a required value."""
    return conform(flatten_details(raw, clock), VIDEO_METADATA)


def enrichments() -> dict[str, Column]:
    """The columns that enrichment adds to metadata."""
    return {
        "video_type": titles.video_type(F.col("title")),
        "review_score": titles.review_score(F.col("description")),
    }


def enrich(metadata: DataFrame) -> DataFrame:
    return metadata.select("id", "url", *[c.alias(n) for n, c in enrichments().items()])


def enrich_new(metadata: DataFrame, enriched: DataFrame, limit: int | None = None) -> DataFrame:
    """Type and score of videos that have none yet."""
    waiting = absent(metadata.select("id", "url", "title", "description"), enriched, "url")
    return enrich(waiting if limit is None else waiting.orderBy("url").limit(limit))


def audio_work_list(
    metadata: DataFrame, audio: DataFrame, age_restricted: DataFrame, n: int, null_aware: bool = False
) -> DataFrame:
    """Urls without audio that may be downloaded."""
    waiting = absent(metadata.select("url"), audio.where(F.col("audio_gcr_uri").isNotNull()), "url", "video_url")
    minus = absent_null_aware if null_aware else absent
    return minus(waiting, age_restricted, "url", "video_url").orderBy("url").limit(n)


def transcription_work_list(
    audio: DataFrame,
    transcripts: DataFrame,
    metadata: DataFrame,
    n: int,
    max_minutes: float = MAX_TRANSCRIBED_MINUTES,
) -> DataFrame:
    """Audio without a transcript whose video is short enough."""
    waiting = absent(audio.select(F.col("video_url").alias("url"), "audio_gcr_uri"), transcripts, "url")
    short = metadata.where(F.col("length") < times.minutes_to_seconds(max_minutes))
    return present(waiting, short, "url").distinct().orderBy("url", "audio_gcr_uri").limit(n)


def new_segments(results: DataFrame, transcripts: DataFrame, clock: datetime | None = None) -> DataFrame:
    """Segment rows of transcription results whose url has no transcript yet."""
    rows = segments_from_results(absent(results, transcripts, "url"), clock)
    return rows.select(*TRANSCRIPTIONS.fieldNames())


def embedding_work_list(transcripts: DataFrame, embeddings: DataFrame, max_videos: int | None = None) -> DataFrame:
    """All segments of urls that have no chunks yet, of at most ``max_videos`` if given."""
    return for_first_absent(transcripts, embeddings, "url", "video_url", max_videos)


def embed_new(
    transcripts: DataFrame,
    embeddings: DataFrame,
    embedder: Embedder,
    max_videos: int | None = 100,
    sizes: Sequence[int] = (3,),
) -> DataFrame:
    """Chunks with vectors for transcripts that have none yet; ``max_videos=None`` takes all."""
    chunks = chunk_segments(embedding_work_list(transcripts, embeddings, max_videos), sizes)
    return chunks.withColumn("embedding", embed(F.col("text"), embedder)).drop("text")


def _ready(videos: DataFrame, transcripts: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Videos with a transcript and with chunks."""
    return present(present(videos, transcripts, "url"), embeddings, "url", "video_url")


def metadata_delta(
    metadata: DataFrame,
    enriched: DataFrame,
    transcripts: DataFrame,
    embeddings: DataFrame,
    served_metadata: DataFrame,
    null_aware: bool = False,
) -> DataFrame:
    """Complete videos that are not served yet, with type and score."""
    minus = absent_null_aware if null_aware else absent
    fresh = minus(_ready(metadata, transcripts, embeddings), served_metadata, "id")
    return fresh.join(enriched.select("id", "video_type", "review_score"), "id")


def transcripts_delta(
    metadata: DataFrame,
    transcripts: DataFrame,
    embeddings: DataFrame,
    served_metadata: DataFrame,
    served_transcripts: DataFrame,
    null_aware: bool = False,
) -> DataFrame:
    """Segments of complete videos that are not served yet."""
    minus = absent_null_aware if null_aware else absent
    # The transcripts are one side of the join below, so they need no test here.
    fresh = minus(present(metadata.select("id", "url"), embeddings, "url", "video_url"), served_metadata, "id")
    # The two sets of urls are reduced to one first; segments then meet it in a single semi join.
    waiting = absent(fresh.select("url"), served_transcripts, "url")
    rows = transcripts.select("url", "text", "segment_id", "segment_seek", "segment_start", "segment_end")
    return present(rows, waiting, "url")


def embeddings_delta(
    embeddings: DataFrame, served_embeddings: DataFrame, max_videos: int | None, null_aware: bool = False
) -> DataFrame:
    """Chunk rows, each once, of urls that are not served yet, of at most ``max_videos`` if given."""
    named = embeddings.withColumnRenamed("video_url", "url")
    minus = absent_null_aware if null_aware else absent
    waiting = first_keys(minus(named.select("url"), served_embeddings, "url"), "url", max_videos)
    fresh = absent(present(named, waiting, "url"), served_embeddings, "id")
    return fresh.select(
        "id", "url", "embedding_type", "start_segment", "end_segment", "segment_length", "gcs_uri"
    ).distinct()


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk rows with their vector, one per id; rows without a vector are left out.

    The delta is written first.  Its size is then known, and a small one is
    sent to the vectors, which are much wider and would be shuffled otherwise.
    """
    once = to_scratch(keep_first(chunks, ["id"], [F.col(c) for c in chunks.columns if c != "id"]), "delta")
    return once.join(vectors.select("id", "embedding"), "id").drop("gcs_uri")


def backfill_segments(archive: DataFrame, metadata: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Archived segments of known videos that have no transcript."""
    needed = absent(metadata.select("url"), transcripts, "url")
    results = archive.select(F.col("video_url").alias("url"), F.lit("en").alias("language"), "segments", "created_at")
    rows = segments_from_results(present(results, needed, "url"), created_at=F.col("created_at"))
    return rows.select(*TRANSCRIPTIONS.fieldNames())


def merge_audio(audio: DataFrame, archive: DataFrame, bucket: str) -> DataFrame:
    """Audio rows plus archived ones under their blob address; a later row wins."""
    fresh = absent(archive.select("video_url", "video_id", "created_at"), audio, "video_url").select(
        "video_url",
        blob_uri(bucket, F.concat(F.col("video_id"), F.lit(".mp3"))).alias("audio_gcr_uri"),
        F.col("created_at").cast("timestamp_ntz").alias("scrape_date"),
    )
    tie = [F.col("scrape_date").desc(), F.col("audio_gcr_uri").desc()]
    return union_first_wins([fresh, audio.select(*fresh.columns)], ["video_url"], tie)


def audio_with_blob(audio: DataFrame, objects: DataFrame, bucket: str) -> DataFrame:
    """Audio rows whose file exists; ``objects`` has the ``name`` of each file."""
    known = objects.select(blob_uri(bucket, F.col("name")).alias("audio_gcr_uri"))
    return present(audio, known, "audio_gcr_uri")


def run_jobs(spark: SparkSession, jobs: Sequence[tuple[str, Callable[[], object]]]) -> DataFrame:
    """Run jobs in order; a failing job does not stop the rest.

    Returns ``job, ok, error``.
    """
    status = []
    for name, job in jobs:
        try:
            job()
            status.append((name, True, None))
        except Exception as error:
            status.append((name, False, f"{error}\n{traceback.format_exc()}"))
    return spark.createDataFrame(status, "job string, ok boolean, error string")
