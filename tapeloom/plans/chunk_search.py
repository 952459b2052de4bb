"""Searches that return chunks or segments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.embed import Embedder, HashedWords, embed_one
from ..functions.scores import FUSION_K, reciprocal_rank, weighted_sum
from ..operators import ivf, keyword, nearest, word_index
from ..operators.chunks import with_spaced_text
from ..operators.filters import Filters
from ..operators.fusion import first_known
from ..operators.joins import Keys, flag_null, interval_join, present, restrict, short_list
from ..operators.rows import keep_first, top_k, top_per_group
from ..session import PIN_ROWS, fixed

NO_FILTERS = Filters()
Urls = Keys


@dataclass(frozen=True)
class SearchTables:
    """The tables a search reads, how texts become vectors, and a vector index.

    ``embeddings(id, url, start_segment, end_segment, embedding)``,
    ``transcripts(url, text, segment_id, segment_seek, segment_start, segment_end)``,
    ``metadata(url, publish_date, video_type, review_score, ...)`` with unique urls,
    ``chunk_text(id, url, start_segment, end_segment, text, segment_start, segment_end)``.
    With a ``vocabulary(term, stem)`` words match by their English stem, otherwise as they are.
    With ``postings`` words and phrases are looked up in a stored index, by stems if it holds
    stems, and of ``transcripts`` only the rows of the winners are read.
    """

    embeddings: DataFrame
    transcripts: DataFrame
    metadata: DataFrame
    chunk_text: DataFrame
    embedder: Embedder = HashedWords()
    index: ivf.IvfIndex | None = None
    probes: int = 50
    vocabulary: DataFrame | None = None
    postings: word_index.WordIndex | None = None

    def word_rank(self, query: str) -> Column:
        """Rank of a segment's text for any word of the query."""
        return keyword.word_rank(F.col("text"), query, self._variants(query))

    def phrase_rank(self, query: str) -> Column:
        """Rank of a segment's text for the query as a phrase."""
        return keyword.phrase_rank(F.col("text"), query, self._variants(query))

    def _variants(self, query: str) -> keyword.Variants | None:
        return None if self.vocabulary is None else keyword.stem_variants(self.vocabulary, query)

    def vector_of(self, query: str | Sequence[float]) -> Sequence[float]:
        """A query is a text, or the vector of one."""
        return embed_one(query, self.embedder) if isinstance(query, str) else query


_CHUNK = ["id", "url", "start_segment", "end_segment"]


def similar_chunks(tables: SearchTables, query: str | Sequence[float], n: int = 10) -> DataFrame:
    """The ``n`` chunks most similar to the query, best first."""
    return nearest.nearest(tables.embeddings, tables.vector_of(query), n)


def similar_chunks_for_urls(
    tables: SearchTables, query: str | Sequence[float], urls: Urls, n_per_url: int = 5
) -> DataFrame:
    """The most similar chunks of each url, with their text, numbered in ``rn``."""
    urls = short_list(urls)
    base = tables.embeddings.select(*_CHUNK, "segment_length", "embedding")
    if isinstance(urls, DataFrame):
        # Many urls: score first, so that no vector takes part in the join.
        found = restrict(nearest.score(base, tables.vector_of(query)), urls, "url")
    else:
        found = nearest.score(restrict(base, urls, "url"), tables.vector_of(query))
    text = restrict(tables.chunk_text, urls, "url").select("url", "id", "segment_start", "segment_end", "text")
    # Chunks without a text are left out by their keys; texts are read for the winners only.
    found = found.join(text.select("url", "id"), ["url", "id"], "left_semi")
    best = top_per_group(found, ["url"], nearest.by_similarity(), n_per_url, rank="rn")
    return nearest.scored(best).join(text, ["url", "id"])


def similar_chunks_filtered(
    tables: SearchTables,
    query: str | Sequence[float],
    n: int = 10,
    screen: int | None = 10_000,
    filters: Filters = NO_FILTERS,
    include_text: bool = False,
) -> DataFrame:
    """The most similar chunks among videos that pass the filters, best first.

    With ``screen`` the filters are applied to that many nearest chunks, so
    fewer than ``n`` rows may come back.  Without it the search is exact and
    filters first.
    """
    vector = tables.vector_of(query)
    base = tables.embeddings.select(*_CHUNK, "embedding")
    allowed = filters.apply(tables.metadata).select("url")
    if screen is None:
        found = nearest.score(base, vector)
        if filters.active():
            found = present(found, allowed, "url")
    else:
        if tables.index is None:
            found = nearest.nearest(base, vector, screen)
        else:
            spark = tables.embeddings.sparkSession
            found = ivf.search(spark, tables.index, vector, screen, tables.probes, columns=_CHUNK)
        if filters.active():
            # The screened side has at most ``screen`` rows; the metadata has any number.
            side = F.broadcast(found) if screen <= PIN_ROWS else found
            found = allowed.join(side, "url").select(*_CHUNK, "cos_sim")
    found = nearest.scored(top_k(found, nearest.by_similarity(), n))
    return _with_text(tables, found, n) if include_text else found


def _with_text(tables: SearchTables, found: DataFrame, n: int) -> DataFrame:
    """Late text fetch for a list of at most ``n`` chunks, best first."""
    chunks, urls = fixed(found, n, "url")
    segments = tables.transcripts if urls is None else restrict(tables.transcripts, urls, "url")
    return with_spaced_text(chunks, segments).orderBy(*nearest.by_similarity())


def _matching(ranked: DataFrame) -> DataFrame:
    """Rows whose ``rank`` is above 0.

    A plain filter would be pushed below the projection and work the rank out twice; one on what a generator
    puts out stays above it.
    """
    kept = F.explode_outer(F.filter(F.array("rank"), lambda r: r > 0))
    rest = [c for c in ranked.columns if c != "rank"]
    return ranked.select(*rest, kept.alias("rank")).where(F.col("rank").isNotNull())


_SEGMENT = ["url", "segment_id", "segment_seek", "segment_start", "segment_end"]


def segment_hits(tables: SearchTables, query: str, filters: Filters = NO_FILTERS) -> DataFrame:
    """Every segment with a word of the query, with its ``rank``, and its text unless ``postings`` are given."""
    if tables.postings is None:
        hits = _matching(tables.transcripts.select(*_SEGMENT, "text", tables.word_rank(query).alias("rank")))
    else:
        hits = word_index.hits(tables.transcripts.sparkSession, tables.postings, query)
    if filters.active():
        hits = present(hits, filters.apply(tables.metadata).select("url"), "url")
    return hits


def best_segment_hits(
    tables: SearchTables, query: str, n: int, filters: Filters = NO_FILTERS, phrase: bool = False
) -> DataFrame:
    """The ``n`` best of ``segment_hits``, or of the segments that hold the query as a phrase."""
    if tables.postings is not None:
        allowed = filters.apply(tables.metadata).select("url") if filters.active() else None
        return word_index.top_hits(tables.transcripts.sparkSession, tables.postings, query, n, phrase, allowed)
    if not phrase:
        return top_k(segment_hits(tables, query, filters), by_rank(), n)
    ranked = tables.transcripts.select(*_SEGMENT, tables.phrase_rank(query).alias("rank"))
    return top_k(_matching(ranked), by_rank(), n)


def with_segments(tables: SearchTables, hits: DataFrame, columns: Sequence[str], urls: Urls | None = None) -> DataFrame:
    """Hits with columns of their segments, which hits from ``postings`` lack."""
    if tables.postings is None:
        return hits
    segments = tables.transcripts if urls is None else restrict(tables.transcripts, urls, "url")
    return hits.join(segments.select("url", "segment_id", *columns), ["url", "segment_id"])


def by_rank() -> list:
    return [F.col("rank").desc(), F.col("url"), F.col("segment_id")]


def keyword_segments(
    tables: SearchTables,
    query: str,
    n: int | None = 10,
    filters: Filters = NO_FILTERS,
    include_text: bool = False,
) -> DataFrame:
    """Segments with any word of the query and their video's title, best first.

    ``n=None`` returns all of them.
    """
    titles, urls = tables.metadata.select("url", "title"), None
    if n is None:
        hits = segment_hits(tables, query, filters)
    else:
        hits, urls = fixed(best_segment_hits(tables, query, n, filters), n, "url")
        titles = titles if urls is None else restrict(titles, urls, "url")
    hits = with_segments(tables, hits, [*_SEGMENT[2:], *(["text"] if include_text else [])], urls)
    wanted = ["title", "url", *(["text"] if include_text else []), F.col("segment_id").alias("id")]
    return (
        hits.join(titles, "url", "left")
        .orderBy(*by_rank())
        .select(*wanted, "segment_seek", "segment_start", "segment_end", "rank")
    )


def phrase_segments(tables: SearchTables, query: str, n: int = 10) -> DataFrame:
    """Segments that hold the query as a phrase, best first."""
    best, urls = best_segment_hits(tables, query, n, phrase=True), None
    if tables.postings is not None:
        best, urls = fixed(best, n, "url")
    found = with_segments(tables, best, _SEGMENT[2:], urls).select(*_SEGMENT, "rank")
    return found.withColumnRenamed("segment_id", "id")


def phrase_chunks_for_urls(
    tables: SearchTables, query: str, urls: Urls, n_per_url: int = 5, best_per_chunk: bool = False
) -> DataFrame:
    """Chunks of each url around segments that hold the phrase, numbered in ``rn``.

    A chunk appears once per matching segment, or once with its best segment.
    """
    urls = short_list(urls)
    if tables.postings is None:
        ranked = restrict(tables.transcripts, urls, "url").select(
            "url", "segment_id", "segment_seek", tables.phrase_rank(query).alias("rank")
        )
    else:
        ranked = restrict(word_index.hits(tables.transcripts.sparkSession, tables.postings, query, True), urls, "url")
        ranked = with_segments(tables, ranked, ["segment_seek"], urls)
    chunks = restrict(tables.chunk_text, urls, "url")
    # Texts join after the ranking, so that expanding the ranges copies only keys.
    found = interval_join(chunks.select(*_CHUNK), ranked.where(F.col("rank") > 0), "url", "segment_id")
    order = [F.col("rank").desc(), F.col("id"), F.col("segment_id")]
    if best_per_chunk:
        found = keep_first(found, ["url", "id"], order)
    picked = top_per_group(found, ["url"], order, n_per_url, rank="rn").select("url", "id", "segment_seek", "rank", "rn")
    texts = chunks.select("url", "id", "segment_start", "segment_end", "text")
    return picked.join(texts, ["url", "id"]).select(
        "url", "id", "segment_seek", "segment_start", "segment_end", "text", "rank", "rn", flag_null("cos_sim", "double")
    )


def hybrid_chunks_for_urls(
    tables: SearchTables,
    query: str,
    urls: Urls,
    n_per_url: int = 5,
    k: int = FUSION_K,
    neural_weight: float = 0.8,
    keyword_weight: float = 1.0,
    vector: Sequence[float] | None = None,
) -> DataFrame:
    """The best chunks of each url by both rankings, fused.

    ``rn`` is the dense rank of the fused score inside the url.
    """
    deep = math.ceil(n_per_url * 2)
    urls = short_list(urls)
    by_vector = similar_chunks_for_urls(tables, query if vector is None else vector, urls, deep).alias("n")
    by_phrase = phrase_chunks_for_urls(tables, query, urls, deep, best_per_chunk=True).alias("p")
    same = (F.col("n.url") == F.col("p.url")) & (F.col("n.id") == F.col("p.id"))
    joined = by_vector.join(by_phrase, same, "full_outer").select(
        first_known("url", "n", "p"),
        first_known("id", "n", "p"),
        first_known("text", "n", "p"),
        F.col("n.cos_sim").alias("cos_sim"),
        F.col("p.rank").alias("rank"),
        reciprocal_rank(F.col("n.rn"), k).alias("neural_score"),
        reciprocal_rank(F.col("p.rn"), k).alias("keyword_score"),
        F.least("n.segment_start", "p.segment_start").alias("segment_start"),
        F.greatest("n.segment_end", "p.segment_end").alias("segment_end"),
    )
    fused = weighted_sum(F.col("neural_score"), neural_weight, F.col("keyword_score"), keyword_weight)
    scored = joined.withColumn("fused_score", F.round(fused, 15))
    per_url = Window.partitionBy("url")
    order = [F.col(c).desc() for c in ("fused_score", "keyword_score", "neural_score")]
    ranked = scored.withColumn("rn", F.dense_rank().over(per_url.orderBy(F.col("fused_score").desc()))).withColumn(
        "place", F.row_number().over(per_url.orderBy(*order, F.col("id")))
    )
    return ranked.where(F.col("place") <= n_per_url).drop("neural_score", "keyword_score")
