"""Chunks of segments and their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import HashedWords
from ..operators import chunks, joins, rows
from ..plans import corpus, jobs
from ..plans.corpus import table, with_ctes
from ..session import scratch_dir


def chunk_segments(spark, sf_dir):
    return chunks.chunk_segments(corpus.transcripts(spark, sf_dir), (3,))


def chunk_segments_two_sizes(spark, sf_dir):
    return chunks.chunk_segments(corpus.transcripts(spark, sf_dir), (4, 8))


def chunk_segments_sliced(spark, sf_dir):
    """The same with every long transcript numbered slice by slice."""
    return chunks.chunk_segments(corpus.transcripts(spark, sf_dir), (3,), hot_rows=2)


CHUNKS = """SELECT concat(list_last(string_split(url, 'watch?v=')), '_', start_segment, '_', start_segment + size) AS id,
  url AS video_url, 'segment_chunk' AS embedding_type, CAST(start_segment AS INT) AS start_segment,
  CAST(start_segment + size AS INT) AS end_segment, CAST(size AS INT) AS segment_length,
  trim(string_agg(text, ' ' ORDER BY pos)) AS text
FROM (SELECT url, text, pos, size, pos // size * size AS start_segment FROM (
    SELECT url, text, row_number() OVER (PARTITION BY url ORDER BY segment_start, segment_id) - 1 AS pos FROM tr)
  CROSS JOIN (SELECT unnest([{sizes}]) AS size))
GROUP BY url, size, start_segment"""


def chunk_text(spark, sf_dir):
    return corpus.chunk_text(spark, sf_dir)


def chunk_text_spaced(spark, sf_dir):
    wanted = corpus.embeddings(spark, sf_dir).select("id", "url", "start_segment", "end_segment")
    return chunks.with_spaced_text(wanted, corpus.transcripts(spark, sf_dir))


def segments_in_chunks(spark, sf_dir):
    wanted = corpus.embeddings(spark, sf_dir).select("id", "url", "start_segment", "end_segment")
    points = corpus.transcripts(spark, sf_dir).select("url", "segment_id", "segment_start")
    return joins.interval_join(wanted, points, "url", "segment_id")


def expanded_ranges(spark, sf_dir):
    wanted = corpus.embeddings(spark, sf_dir).select("id", "start_segment", "end_segment")
    return joins.expand_range(wanted, "start_segment", "end_segment", "video_segment")


def embed_chunks(spark, sf_dir):
    """Chunks of all new transcripts with their vectors, summed up per chunk."""
    none = corpus.warehouse_embeddings(spark, sf_dir).where(F.col("video_url").isNull())
    made = jobs.embed_new(corpus.transcripts(spark, sf_dir), none, HashedWords(64), max_videos=None)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("id", "video_url", "start_segment", "end_segment", F.size("embedding").alias("dims"), F.round(square, 4).alias("norm"))


def event_positions(spark, sf_dir):
    """Number of every event in its user's history."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.number_rows(events, ["user_id"], ["at", "event_id"], "position", hot_rows=50).drop("at")


def chunk_text_refreshed(spark, sf_dir):
    """Chunk texts that were stored before a third of the urls came in, and then brought up to date."""
    made, segments = corpus.embeddings(spark, sf_dir), corpus.transcripts(spark, sf_dir)
    late, path = F.pmod(F.xxhash64("url"), F.lit(3)) == 0, scratch_dir(spark, "chunk-text")
    chunks.refresh_chunk_text(made.where(~late), segments.where(~late), path, buckets=32)
    changed = made.where(late).select("url").union(segments.where(late).select("url"))
    chunks.refresh_chunk_text(made, segments, path, changed, 32)
    return spark.read.parquet(path).drop("bucket")


CHECKS = {
    "chunk_segments": (chunk_segments, with_ctes(CHUNKS.format(sizes="3"), "tr")),
    "chunk_segments_two_sizes": (chunk_segments_two_sizes, with_ctes(CHUNKS.format(sizes="4, 8"), "tr")),
    "chunk_segments_sliced": (chunk_segments_sliced, with_ctes(CHUNKS.format(sizes="3"), "tr")),
    "chunk_text": (chunk_text, with_ctes("SELECT * FROM ct", "ct")),
    "chunk_text_refreshed": (chunk_text_refreshed, with_ctes("SELECT * FROM ct", "ct")),
    "chunk_text_spaced": (
        chunk_text_spaced,
        with_ctes(
            """SELECT em.id, em.url, em.start_segment, em.end_segment,
  coalesce(string_agg(trim(tr.text), ' ' ORDER BY tr.segment_id), '') AS text
FROM em LEFT JOIN tr ON tr.url = em.url AND tr.segment_id >= em.start_segment AND tr.segment_id < em.end_segment
GROUP BY em.id, em.url, em.start_segment, em.end_segment""",
            "em",
            "tr",
        ),
    ),
    "segments_in_chunks": (
        segments_in_chunks,
        with_ctes(
            """SELECT em.id, em.url, em.start_segment, em.end_segment, tr.segment_id, tr.segment_start
FROM em JOIN tr ON tr.url = em.url AND tr.segment_id >= em.start_segment AND tr.segment_id < em.end_segment""",
            "em",
            "tr",
        ),
    ),
    "expanded_ranges": (
        expanded_ranges,
        with_ctes(
            """SELECT id, start_segment, end_segment,
  CAST(unnest(range(start_segment, end_segment)) AS INT) AS video_segment FROM em""",
            "em",
        ),
    ),
    "embed_chunks": (
        embed_chunks,
        with_ctes(
            f"""SELECT id, video_url, start_segment, end_segment, 64 AS dims, 1.0::DOUBLE AS norm
FROM ({CHUNKS.format(sizes='3')})""",
            "tr",
        ),
    ),
    "event_positions": (
        event_positions,
        """SELECT event_id, user_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS position FROM events""",
    ),
}
