"""Searches that return videos."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import null_to_zero, rank_share, weighted_mean, weighted_sum
from ..operators.chunks import with_spaced_text
from ..operators.filters import Filters
from ..operators.fusion import add_z_scores, first_known
from ..operators.joins import restrict
from ..operators.nearest import by_similarity
from ..operators.rows import top_k, top_per_group
from ..session import fixed, settled, to_scratch
from .chunk_search import (
    NO_FILTERS,
    SearchTables,
    Urls,
    best_segment_hits,
    by_rank,
    hybrid_chunks_for_urls,
    phrase_chunks_for_urls,
    segment_hits,
    similar_chunks_filtered,
    similar_chunks_for_urls,
    with_segments,
)


def group_scores(chunks: DataFrame, group: str, per_group: int, id_col: str = "id") -> DataFrame:
    """Similarity statistics of each group's best chunks.

    The standard score of the maximum is taken over all groups; it is weighted
    by the number of chunks to give ``weighted_z_score``.
    """
    best = top_per_group(chunks, [group], by_similarity(id_col), per_group)
    stats = best.groupBy(group).agg(
        F.median("cos_sim").alias("median_similarity"),
        F.avg("cos_sim").alias("average_similarity"),
        F.count("cos_sim").alias("n_similar_chunks"),
        F.max("cos_sim").alias("max_similarity"),
    )
    scored = add_z_scores(
        stats, {"max_similarity": "cos_sim_z_score", "n_similar_chunks": "n_similar_chunks_z_score"}
    )
    n = F.col("n_similar_chunks")
    return scored.withColumn("weighted_z_score", F.col("cos_sim_z_score") * n).withColumn(
        "weighted_median_similarity", F.col("median_similarity") * n
    )


def best_groups(scored: DataFrame, group: str, min_chunks: int, n: int) -> DataFrame:
    order = [F.round("weighted_z_score", 12).desc_nulls_last(), F.col(group)]
    return top_k(scored.where(F.col("n_similar_chunks") >= min_chunks), order, n)


def ordered_list(order: str, value: str) -> Column:
    """Aggregate: values of a bounded group by ascending ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return F.transform(pairs, lambda p: p[value])


def _numbered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number a result of a few rows in ``position``."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order))).orderBy("position")


def neural_ranking(
    candidates: DataFrame, n_chunks_per_video: int = 5, min_chunks: int = 2, n_videos: int = 10
) -> DataFrame:
    """The best videos of a list of candidate chunks, with their scores."""
    return best_groups(group_scores(candidates, "url", n_chunks_per_video), "url", min_chunks, n_videos)


def _best_first(score: str) -> list[Column]:
    return [F.round(score, 12).desc_nulls_last(), F.col("url")]


@dataclass(frozen=True)
class _Winners:
    """Best videos with scores and metadata, and the chunks or segments they won by."""

    videos: DataFrame
    urls: Urls
    found: DataFrame


def _neural_winners(
    tables: SearchTables,
    query: str | Sequence[float],
    filters: Filters,
    n_chunks_to_consider: int = 1500,
    n_chunks_per_video: int = 5,
    n_videos: int = 10,
    min_chunks: int = 2,
    screen: int | None = 5000,
) -> _Winners:
    similar = similar_chunks_filtered(tables, query, n_chunks_to_consider, screen, filters)
    candidates, _ = fixed(similar, n_chunks_to_consider, "url")
    rows, urls = settled(neural_ranking(candidates, n_chunks_per_video, min_chunks, n_videos), n_videos, "url")
    scores = rows.select(
        "url",
        F.col("n_similar_chunks").alias("n_segment_matches"),
        F.col("weighted_z_score").alias("neural_search_score"),
    )
    videos = restrict(tables.metadata, urls, "url").join(scores, "url")
    return _Winners(
        add_z_scores(videos, {"neural_search_score": "neural_search_score_z_score"}), urls, candidates
    )


def _with_chunks(tables: SearchTables, won: _Winners, n_chunks: int) -> DataFrame:
    shown = top_per_group(restrict(won.found, won.urls, "url"), ["url"], by_similarity(), n_chunks, rank="_nth")
    texts = with_spaced_text(shown, restrict(tables.transcripts, won.urls, "url"))
    lists = texts.groupBy("url").agg(ordered_list("_nth", "text").alias("top_segment_chunks"))
    return _numbered(lists.join(won.videos, "url"), _best_first("neural_search_score"))


def neural_search(
    tables: SearchTables,
    query: str | Sequence[float],
    filters: Filters = NO_FILTERS,
    n_chunks_to_consider: int = 1500,
    n_chunks_per_video: int = 5,
    n_videos: int = 10,
    n_chunks_to_show: int = 3,
    min_chunks: int = 2,
    screen: int | None = 5000,
) -> DataFrame:
    """Videos whose chunks are most similar to the query, with their best chunks.

    The vectors are scanned once; the candidates and the winners are short
    lists, and only the winners' metadata and text are read.
    """
    won = _neural_winners(
        tables, query, filters, n_chunks_to_consider, n_chunks_per_video, n_videos, min_chunks, screen
    )
    return _with_chunks(tables, won, n_chunks_to_show)


def keyword_group_scores(hits: DataFrame) -> DataFrame:
    """Per video: median and mean rank, number of hits, and standard scores."""
    stats = hits.groupBy("url").agg(
        F.median("rank").alias("median_rank"), F.avg("rank").alias("mean_rank"), F.count("rank").alias("n_results")
    )
    # One row per video, written once: the scores read it for their mean and for themselves.
    scored = to_scratch(stats.withColumn("keyword_search_score", F.col("median_rank")), "keyword-groups")
    return add_z_scores(scored, {"keyword_search_score": "keyword_search_score_z_score"})


def _keyword_winners(
    tables: SearchTables, query: str, filters: Filters, n_results_to_consider: int | None = None, n_videos: int = 5
) -> _Winners:
    if n_results_to_consider is None:
        hits = segment_hits(tables, query, filters)
    else:
        hits, _ = fixed(best_segment_hits(tables, query, n_results_to_consider, filters), n_results_to_consider, "url")
    best = top_k(keyword_group_scores(hits), _best_first("keyword_search_score"), n_videos)
    rows, urls = settled(best, n_videos, "url")
    scores = rows.select(
        "url",
        F.col("n_results").alias("n_segment_matches"),
        "keyword_search_score",
        "keyword_search_score_z_score",
    )
    found = _numbered(restrict(tables.metadata, urls, "url").join(scores, "url"), _best_first("keyword_search_score"))
    videos, urls = settled(found, n_videos, "url")
    if isinstance(urls, list) and len(urls) == 1:
        videos = videos.withColumns(
            {"keyword_search_score": F.lit(1.0), "keyword_search_score_z_score": F.lit(0.5)}
        )
    return _Winners(videos, urls, hits)


def keyword_search(
    tables: SearchTables,
    query: str,
    filters: Filters = NO_FILTERS,
    n_results_to_consider: int | None = None,
    n_videos: int = 5,
    n_segments_per_video: int = 3,
) -> DataFrame:
    """Videos whose segments match the query's words best, with their best segments.

    A single result scores 1 with a standard score of 0.5.
    """
    won = _keyword_winners(tables, query, filters, n_results_to_consider, n_videos)
    best = top_per_group(restrict(won.found, won.urls, "url"), ["url"], by_rank(), n_segments_per_video, rank="_nth")
    best = with_segments(tables, best, ["text"], won.urls)
    lists = best.groupBy("url").agg(ordered_list("_nth", "text").alias("top_segment_chunks"))
    return won.videos.join(lists, "url").orderBy("position")


def rerank_chunks_for_urls(
    tables: SearchTables,
    query: str,
    urls: Urls,
    method: str = "hybrid",
    n_chunks: int = 3,
    neural_weight: float = 0.6,
    keyword_weight: float = 1.0,
    vector: Sequence[float] | None = None,
) -> DataFrame:
    """The best chunks of each url as parallel lists of texts and similarities."""
    place = "rn"
    if method == "neural":
        found = similar_chunks_for_urls(tables, query if vector is None else vector, urls, n_chunks)
    elif method == "keyword":
        found = phrase_chunks_for_urls(tables, query, urls, n_chunks)
    elif method == "hybrid":
        found = hybrid_chunks_for_urls(
            tables, query, urls, n_chunks, neural_weight=neural_weight, keyword_weight=keyword_weight, vector=vector
        )
        place = "place"
    else:
        raise ValueError(f"unknown method: {method}")
    lists = found.groupBy("url").agg(
        ordered_list(place, "text").alias("texts"), ordered_list(place, "cos_sim").alias("sims")
    )
    return lists.select(
        "url",
        F.transform("texts", lambda t: F.trim(t)).alias("top_segment_chunks"),
        null_to_zero(F.col("sims")).alias("cos_sim"),
    )


_NEURAL_COLUMNS = ["n_segment_matches", "neural_search_score", "neural_search_score_z_score", "position"]


def fuse_videos(
    neural: DataFrame, keyword: DataFrame, neural_weight: float, keyword_weight: float, max_results: int
) -> DataFrame:
    """Merge two numbered lists of videos by reciprocal rank.

    A video missing from one list scores 0 there; metadata comes from the
    neural list first.
    """
    details = [c for c in neural.columns if c not in _NEURAL_COLUMNS and c != "url"]
    joined = neural.alias("n").join(keyword.alias("k"), F.col("n.url") == F.col("k.url"), "full_outer")
    zero = F.lit(0.0)
    merged = joined.select(
        first_known("url", "n", "k"),
        rank_share(F.col("n.position")).alias("neural_score"),
        F.coalesce(F.col("n.neural_search_score_z_score"), zero).alias("neural_search_score_z_score"),
        rank_share(F.col("k.position")).alias("keyword_score"),
        F.coalesce(F.col("k.keyword_search_score_z_score"), zero).alias("keyword_search_score_z_score"),
        *[first_known(c, "n", "k") for c in details],
    )
    fused = merged.withColumn(
        "fused_score", weighted_sum(F.col("neural_score"), neural_weight, F.col("keyword_score"), keyword_weight)
    ).withColumn(
        "avg_z_score",
        weighted_mean(
            F.col("neural_search_score_z_score"), neural_weight, F.col("keyword_search_score_z_score"), keyword_weight
        ),
    )
    order = [F.round("fused_score", 12).desc(), F.round("avg_z_score", 12).desc_nulls_last(), F.col("url")]
    return _numbered(top_k(fused, order, max_results), order)


def hybrid_search(
    tables: SearchTables,
    query: str,
    filters: Filters = NO_FILTERS,
    max_videos_per_method: int = 5,
    max_results: int = 10,
    keyword_weight: float = 1.0,
    neural_weight: float = 1.0,
    vector: Sequence[float] | None = None,
    screen: int | None = 5000,
) -> DataFrame:
    """Both video searches, fused, with re-ranked chunks.

    Without keyword results the neural result is returned as it is.
    """
    spark = tables.transcripts.sparkSession
    side = query if vector is None else vector

    def by_vector() -> tuple[_Winners, DataFrame]:
        won = _neural_winners(tables, side, filters, n_videos=max_videos_per_method, screen=screen)
        return won, settled(_numbered(won.videos, _best_first("neural_search_score")), max_videos_per_method, "url")[0]

    def by_words() -> _Winners:
        return _keyword_winners(tables, query, filters, n_videos=max_videos_per_method)

    # The two searches do not depend on each other, so their jobs run side by side.
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(inheritable_thread_target(spark)(by_vector))
        second = pool.submit(inheritable_thread_target(spark)(by_words))
        (neural, neural_rows), keyword = first.result(), second.result()
    if isinstance(keyword.urls, list) and not keyword.urls:
        return _with_chunks(tables, neural, 3)
    merged = fuse_videos(neural_rows, keyword.videos, neural_weight, keyword_weight, max_results)
    fused_rows, urls = settled(merged, max_results, "url")
    lists = rerank_chunks_for_urls(tables, query, urls, "hybrid", 3, vector=vector)
    return fused_rows.join(lists, "url", "left").orderBy("position")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    neural_strength: float
    keyword_strength: float
    filters: Filters = NO_FILTERS
    vector: Sequence[float] | None = None


def search(tables: SearchTables, request: SearchRequest) -> DataFrame:
    """Pick the search by the strengths: 1 for one side means that side alone."""
    if request.neural_strength == 1:
        return neural_search(tables, request.query if request.vector is None else request.vector, request.filters)
    if request.keyword_strength == 1:
        return keyword_search(tables, request.query, request.filters)
    return hybrid_search(
        tables,
        request.query,
        request.filters,
        keyword_weight=request.keyword_strength,
        neural_weight=request.neural_strength,
        vector=request.vector,
    )
