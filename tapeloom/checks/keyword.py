"""Word and phrase search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import keyword
from ..operators.filters import Filters
from ..plans import chunk_search, corpus, video_search
from ..plans.corpus import table, with_ctes
from ..session import scratch_dir

WORDS = "the la der that rethen onat"
WANTED = ["la", "der", "rethen", "onat"]
PHRASE = "de la"
GAP_PHRASE = "thanedble the anea"
BREAK = r"[^\p{L}\p{N}]+"
TOKENS = f"list_filter(string_split_regex(lower(text), '{BREAK}'), lambda w: w <> '')"
COUNT = f"len(list_filter({TOKENS}, lambda w: list_contains({WANTED}, w)))"

# Phrase occurrences in a list of words `w`: starts of "de la", and of "thanedble" + a word + "anea".
PAIRS = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'de' AND w[i + 1] = 'la'))"
GAPPED = "len(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'thanedble' AND w[i + 2] = 'anea'))"


def _hits(df, *keys):
    return df.select(*keys, F.round("rank", 6).alias("rank"))


def keyword_segments(spark, sf_dir):
    found = chunk_search.keyword_segments(corpus.search_tables(spark, sf_dir), WORDS, n=25, include_text=True)
    return found.withColumn("rank", F.round("rank", 6))


KEYWORD = f"""SELECT md.title, tr.url, tr.text, tr.segment_id AS id, tr.segment_seek, tr.segment_start, tr.segment_end,
  round({COUNT.replace('text', 'tr.text')} * 0.1, 6)::DOUBLE AS rank
FROM tr LEFT JOIN md ON md.url = tr.url WHERE {COUNT.replace('text', 'tr.text')} > 0"""


def keyword_segments_filtered(spark, sf_dir):
    filters = Filters(video_type=["misc", "album_review"], review_score=[None, 9])
    found = chunk_search.keyword_segments(corpus.search_tables(spark, sf_dir), WORDS, None, filters)
    return found.withColumn("rank", F.round("rank", 6))


def keyword_documents(spark, sf_dir):
    """Every document with a word of the query."""
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select("doc_id", keyword.word_rank(F.col("text"), WORDS).alias("rank"))
    return _hits(ranked.where(F.col("rank") > 0), "doc_id")


def phrase_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select("doc_id", keyword.phrase_rank(F.col("text"), PHRASE).alias("rank"))
    return _hits(ranked.where(F.col("rank") > 0), "doc_id")


def phrase_documents_gap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select("doc_id", keyword.phrase_rank(F.col("text"), GAP_PHRASE).alias("rank"))
    return _hits(ranked.where(F.col("rank") > 0), "doc_id")


def _documents(expression: str, weight: float) -> str:
    return f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents)
SELECT doc_id, round({expression} * {weight}, 6)::DOUBLE AS rank FROM d WHERE {expression} > 0"""


# "thanedble x anea" scores half unless x is one of the two words.
GAP_RANK = """list_sum(list_transform(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'thanedble' AND w[i + 2] = 'anea'),
  lambda i: CASE WHEN w[i + 1] IN ('thanedble', 'anea') THEN 0.1 ELSE 0.05 END))"""
GAP_DOCUMENTS = f"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents)
SELECT doc_id, round({GAP_RANK}, 6)::DOUBLE AS rank FROM d WHERE {GAPPED} > 0"""


def phrase_segments(spark, sf_dir):
    found = chunk_search.phrase_segments(corpus.search_tables(spark, sf_dir), PHRASE, 10)
    return found.withColumn("rank", F.round("rank", 6))


PHRASE_SEGMENTS = f"""SELECT url, segment_id AS id, segment_seek, segment_start, segment_end, round(n * 0.1, 6)::DOUBLE AS rank
FROM (SELECT *, {PAIRS} AS n FROM (SELECT *, {TOKENS} AS w FROM tr)) WHERE n > 0 ORDER BY n DESC, url, segment_id LIMIT 10"""


def _postings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword.postings(docs, ["doc_id"])


def postings_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword.postings(keyword.gathered(docs, ["doc_id"]), ["doc_id"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("terms"), F.sum(F.col("pos").cast("bigint")).alias("places")
    )


POSTINGS = f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM t)
SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms, CAST(sum(pos) AS BIGINT) AS places
FROM p WHERE NOT list_contains({text.INDEX_STOP_WORDS}, term) GROUP BY doc_id"""


def stored_postings_words(spark, sf_dir):
    """The word query on a stored postings table."""
    path = scratch_dir(spark, "postings")
    keyword.write_postings(_postings(spark, sf_dir), path, 8)
    return _hits(keyword.word_hits(spark.read.parquet(path), WORDS, ["doc_id"], 8), "doc_id")


def stored_postings_phrase(spark, sf_dir):
    """The phrase query on a stored postings table."""
    path = scratch_dir(spark, "postings")
    keyword.write_postings(_postings(spark, sf_dir), path, 8)
    return _hits(keyword.phrase_hits(spark.read.parquet(path), GAP_PHRASE, ["doc_id"], 8), "doc_id")


def stemmed_documents(spark, sf_dir):
    """Documents with a word that shares its stem with a word of the query."""
    known = keyword.vocabulary(_postings(spark, sf_dir))
    variants = keyword.stem_variants(known, WORDS)
    docs = table(spark, sf_dir, "documents")
    ranked = docs.select("doc_id", keyword.word_rank(F.col("text"), WORDS, variants).alias("rank"))
    return _hits(ranked.where(F.col("rank") > 0), "doc_id")


def keyword_group_rank(spark, sf_dir):
    hits = chunk_search.segment_hits(corpus.search_tables(spark, sf_dir), WORDS)
    scored = video_search.keyword_group_scores(hits)
    return scored.select(
        "url", "n_results", *[F.round(c, 6).alias(c) for c in ("median_rank", "mean_rank", "keyword_search_score_z_score")]
    )


GROUP_RANK = f"""WITH tr AS ({corpus.CTES['tr'][0]}), h AS (SELECT url, {COUNT} * 0.1::DOUBLE AS rank FROM tr WHERE {COUNT} > 0),
g AS (SELECT url, median(rank) AS m, avg(rank) AS a, count(*) AS n FROM h GROUP BY url),
s AS (SELECT avg(m) AS mm, stddev_samp(m) AS sd FROM g)
SELECT url, n AS n_results, round(m, 6) AS median_rank, round(a, 6) AS mean_rank,
  round((m - mm) / nullif(sd, 0), 6) AS keyword_search_score_z_score FROM g CROSS JOIN s"""


def tsquery_strings(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.or_query(F.col("text")).alias("query"))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.QUERY_STOP_WORDS) + "]"
TSQUERY = f"""WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(text), '\\s+'),
    lambda x: x <> '' AND NOT list_contains({_STOP}, lower(x))) AS w FROM benchmark)
SELECT item_id, coalesce(array_to_string(list_concat(w,
  list_concat(list_transform(range(1, len(w)), lambda i: concat(w[i], ' <-> ', w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' <-> ', w[i + 1], ' <-> ', w[i + 2])))), ' | '), '') AS query
FROM w"""


def phrase_chunks_per_group(spark, sf_dir):
    tables = corpus.search_tables(spark, sf_dir)
    urls = corpus.video_metadata(spark, sf_dir).where("event_type <> 'error'").select("url")
    found = chunk_search.phrase_chunks_for_urls(tables, PHRASE, urls, 5)
    return found.withColumn("rank", F.round("rank", 6)).drop("cos_sim")


PHRASE_CHUNKS = f"""SELECT url, id, segment_seek, segment_start, segment_end, text, round(n * 0.1, 6)::DOUBLE AS rank,
  CAST(rn AS INT) AS rn FROM (
  SELECT h.url, ct.id, h.segment_seek, ct.segment_start, ct.segment_end, ct.text, h.n,
    row_number() OVER (PARTITION BY h.url ORDER BY h.n DESC, ct.id, h.segment_id) AS rn
  FROM (SELECT *, {PAIRS} AS n FROM (SELECT *, {TOKENS} AS w FROM tr)) h
  JOIN ct ON ct.url = h.url AND h.segment_id >= ct.start_segment AND h.segment_id < ct.end_segment
  WHERE h.n > 0 AND h.url IN (SELECT url FROM vm WHERE event_type <> 'error')) WHERE rn <= 5"""


CHECKS = {
    "keyword_segments": (
        keyword_segments,
        with_ctes(f"{KEYWORD} ORDER BY {COUNT.replace('text', 'tr.text')} DESC, tr.url, tr.segment_id LIMIT 25", "tr", "md"),
    ),
    "keyword_segments_filtered": (
        keyword_segments_filtered,
        with_ctes(
            f"SELECT * EXCLUDE (text) FROM ({KEYWORD} AND md.video_type IN ('misc', 'album_review') AND md.review_score <= 9)",
            "tr",
            "md",
        ),
    ),
    "keyword_documents": (
        keyword_documents,
        f"SELECT doc_id, round({COUNT} * 0.1, 6)::DOUBLE AS rank FROM documents WHERE {COUNT} > 0",
    ),
    "phrase_documents": (phrase_documents, _documents(PAIRS, 0.1)),
    "phrase_documents_gap": (phrase_documents_gap, GAP_DOCUMENTS),
    "phrase_segments": (phrase_segments, with_ctes(PHRASE_SEGMENTS, "tr")),
    "postings_counts": (postings_counts, POSTINGS),
    "stored_postings_words": (
        stored_postings_words,
        f"SELECT doc_id, round({COUNT} * 0.1, 6)::DOUBLE AS rank FROM documents WHERE {COUNT} > 0",
    ),
    "stored_postings_phrase": (stored_postings_phrase, GAP_DOCUMENTS),
    "stemmed_documents": (stemmed_documents, None),
    "keyword_group_rank": (keyword_group_rank, GROUP_RANK),
    "tsquery_strings": (tsquery_strings, TSQUERY),
    "phrase_chunks_per_group": (phrase_chunks_per_group, with_ctes(PHRASE_CHUNKS, "tr", "ct", "vm")),
}
