"""Word searches through a stored index; their SQL is that of the searches that read the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.filters import Filters
from ..plans import chunk_search, corpus, video_search
from ..plans.corpus import vector_row, with_ctes
from . import keyword, videos
from .keyword import PHRASE, WORDS
from .videos import QUERY, TYPES


def _rounded(found):
    return found.withColumn("rank", F.round("rank", 6))


def keyword_segments_indexed(spark, sf_dir):
    return _rounded(chunk_search.keyword_segments(corpus.indexed_tables(spark, sf_dir), WORDS, n=25, include_text=True))


def keyword_segments_indexed_filtered(spark, sf_dir):
    filters = Filters(video_type=["misc", "album_review"], review_score=[None, 9])
    return _rounded(chunk_search.keyword_segments(corpus.indexed_tables(spark, sf_dir), WORDS, None, filters))


def phrase_segments_indexed(spark, sf_dir):
    return _rounded(chunk_search.phrase_segments(corpus.indexed_tables(spark, sf_dir), PHRASE, 10))


def phrase_chunks_indexed(spark, sf_dir):
    urls = corpus.video_metadata(spark, sf_dir).where("event_type <> 'error'").select("url")
    return _rounded(chunk_search.phrase_chunks_for_urls(corpus.indexed_tables(spark, sf_dir), PHRASE, urls, 5)).drop("cos_sim")


def keyword_search_indexed(spark, sf_dir):
    found = video_search.keyword_search(corpus.indexed_tables(spark, sf_dir), QUERY)
    return videos._flat(found, "keyword_search_score", "keyword_search_score_z_score")


def keyword_search_indexed_considered(spark, sf_dir):
    found = video_search.keyword_search(corpus.indexed_tables(spark, sf_dir), QUERY, Filters(video_type=TYPES), 40)
    return videos._flat(found, "keyword_search_score", "keyword_search_score_z_score")


def hybrid_search_indexed(spark, sf_dir):
    request = video_search.SearchRequest(QUERY, 0.4, 0.6, vector=vector_row(spark, sf_dir))
    found = video_search.search(corpus.indexed_tables(spark, sf_dir), request)
    return videos._flat(
        found, "neural_score", "neural_search_score_z_score", "keyword_score", "keyword_search_score_z_score",
        "fused_score", "avg_z_score",
    )


def stored_maxima(spark, sf_dir):
    """How often each word stands in one segment at most, from the maxima of the stored index."""
    tables = corpus.indexed_tables(spark, sf_dir)
    return tables.postings._read(spark, "maxima").groupBy("term").agg(F.max("top").alias("top"))


MAXIMA = f"""SELECT term, max(n) AS top FROM (SELECT url, segment_id, term, count(*) AS n
  FROM (SELECT url, segment_id, unnest({keyword.TOKENS}) AS term FROM tr) GROUP BY ALL)
WHERE NOT list_contains({keyword.text.INDEX_STOP_WORDS}, term) GROUP BY term"""

CHECKS = {
    "keyword_segments_indexed": (keyword_segments_indexed, keyword.CHECKS["keyword_segments"][1]),
    "keyword_segments_indexed_filtered": (
        keyword_segments_indexed_filtered, keyword.CHECKS["keyword_segments_filtered"][1],
    ),
    "phrase_segments_indexed": (phrase_segments_indexed, keyword.CHECKS["phrase_segments"][1]),
    "phrase_chunks_indexed": (phrase_chunks_indexed, keyword.CHECKS["phrase_chunks_per_group"][1]),
    "keyword_search_indexed": (keyword_search_indexed, videos.CHECKS["keyword_search_full"][1]),
    "keyword_search_indexed_considered": (
        keyword_search_indexed_considered, videos.CHECKS["keyword_search_considered"][1],
    ),
    "hybrid_search_indexed": (hybrid_search_indexed, videos.CHECKS["hybrid_search"][1]),
    "stored_maxima": (stored_maxima, with_ctes(MAXIMA, "tr")),
}
